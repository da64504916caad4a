import random
from collections import Counter

from refloom.llm import class_pairs, format_dups, quota_sample, shared_spans, visual_forms
from refloom.llm.visual_forms import canonical, look


def test_formats_collapse(spark, monkeypatch):
    rows = [(5, "A  {B}-c", "doi:10.1/x arXiv: 12.3"), (3, "a b C.", "ARXIV:12.3; doi: 10.1/X,"), (9, "abc", "doi:10.1/x"), (8, "ABC", "DOI:10.1/X"), (1, None, "doi:1"), (2, "x", None), (7, "", ""), (6, " ", ";"), (4, "é", "title:é"), (10, "e", "title:e")]
    df = spark.createDataFrame(rows, "ref_id long, title string, normalized_id string").selectExpr("*", "'z' as key", "1 as n", "2 as least")
    want = {(3, 5), (8, 9), (6, 7)}
    for least in (20_000, 2):  # with 2 every repeated key is hot
        monkeypatch.setattr(format_dups, "hot_threshold", lambda total, least=least: least)
        assert {tuple(r) for r in format_dups.copies(df).collect()} == want
        assert {tuple(r) for r in format_dups.collapse(df).collect()} == {(3, 2), (8, 2), (6, 2), (4, 1), (10, 1)}
    assert format_dups.copies(df.limit(0)).count() == 0


def test_canonical_forms():
    same = [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("été", "été"), ("so­ft​", "soft"), ("a b c", "a b c"), ("ﬁnd", "find"), ("Раtіеnt", "Patient"), ("Ⅱ", "II"), ("і́", "í"), ("a‍́", "á")]
    for a, b in same:
        assert canonical(a) == canonical(b) == b
    for a, b in [("x²", "x2"), ("½", "1/2"), ("ℓ", "l"), ("É", "E"), ("a", "A"), ("α", "a"), ("a-b", "a b"), ("a.", "a")]:
        assert canonical(a) != canonical(b)
    assert canonical(None) is None
    assert canonical("") == ""
    random.seed(2)
    for _ in range(500):
        t = "".join(random.choices("ab éе́​ｆﬁ  ", k=20))
        assert canonical(canonical(t)) == canonical(t)


def test_words_keep_their_script():
    for native in ("Москва и Петербург", "Αθήνα ΤΟΜΗ", "С. Петров, В. А. Сосна", "Հայաստան", "ТО", "An α-stable Kα"):
        assert canonical(native) == native or native == "ТО"
    assert canonical("Mосквa и С. Пeтров") == "Москва и С. Петров"
    assert canonical("А. Smith and С. Петров") == "A. Smith and С. Петров"
    assert canonical("Ꮪtanford") == "Stanford"
    assert canonical("ТО") == canonical("TO") == "TO"  # nothing tells its script
    random.seed(3)
    swap = {"а": "a", "о": "o", "С": "C", "М": "M", "A": "А", "o": "о", "c": "с"}
    for _ in range(300):
        t = " ".join("".join(random.choices("аоСМAocкжn.θ", k=random.randrange(1, 6))) for _ in range(4))
        u = "".join(swap.get(c, c) if random.random() < 0.5 else c for c in t)
        assert look(t) == look(u)
        assert canonical(t) == canonical(u) == canonical(canonical(t))


def test_same_look_pairs(spark):
    rows = [(1, "Ann", "t"), (2, "Аnn", "t"), (3, "Ann", None), (4, None, "ｔ"), (5, "", " "), (2, "Аnn", "t")]
    df = spark.createDataFrame(rows, "ref_id long, author string, title string").selectExpr("*", "1 as form", "2 as raw", "3 as fld")
    got = Counter(map(tuple, visual_forms.same_look(df, "ref_id", ["author", "title"]).collect()))
    assert got == Counter({("author", 1, 2): 2, ("author", 2, 3): 2, ("title", 1, 4): 1, ("title", 2, 4): 2})
    assert visual_forms.same_look(df.limit(0), "ref_id", ["author"]).count() == 0


def _longest(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_spans_against_brute_force(spark):
    random.seed(8)
    text = lambda n: "".join(random.choices("abcdé \U0001f642", k=n))
    spans = [text(n) for n in (59, 60, 61, 75, 140)]
    docs = [text(random.randrange(0, 90)) + random.choice(spans) + text(random.randrange(0, 90)) for _ in range(45)] + [None, "", "x" * 300, "x" * 170, text(30)]
    docs.append(docs[0])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 as pos", "2 as hash", "3 as rep")
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if docs[i] and docs[j] and _longest(docs[i], docs[j]) >= 60}
    got = [tuple(r) for r in shared_spans.span_pairs(df, 60).collect()]
    assert set(got) == want
    assert len(got) == len(want)
    found = shared_spans.shared_spans(df, 60).collect()
    for r in found:
        a, b = docs[r.doc_a], docs[r.doc_b]
        assert a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
    shares = {r.doc_id: r for r in shared_spans.shared_share(df, 60).collect()}
    assert len(shares) == len(docs)
    assert shares[0].shared_share == 1.0
    assert shares[45].shared_share is None
    assert shares[46].shared_share == 0.0
    assert shared_spans.span_pairs(df.limit(0)).count() == 0


def test_spans_in_ranges_parts_and_repeating_texts(spark, monkeypatch):
    random.seed(12)
    noise = lambda n: "".join(random.choices("abcdefgh", k=n))
    docs = [noise(random.randrange(0, 50)) + (random.choice(["=", "-+", "abc", "0123456789"]) * 80)[: random.randrange(20, 160)] + noise(random.randrange(0, 50)) for _ in range(40)]
    docs += ["=" * n for n in (59, 60, 61, 100, 500)] + [docs[0], docs[0]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if _longest(docs[i], docs[j]) >= 60}
    monkeypatch.setattr(shared_spans, "MOST_BITS", 14)  # four ranges of the hash
    monkeypatch.setattr(class_pairs, "PART", 3)
    join = class_pairs.class_join
    monkeypatch.setattr(shared_spans, "class_join", lambda *a: join(*a, most=3))
    got = [tuple(r) for r in shared_spans.span_pairs(df, 60).collect()]
    assert set(got) == want
    assert len(got) == len(want)
    covered = {i: set() for i in range(len(docs))}
    for i, a in enumerate(docs):
        for j, b in enumerate(docs):
            if i != j:
                for s in range(len(a) - 59):
                    if a[s : s + 60] in b:
                        covered[i].update(range(s, s + 60))
    assert {r.doc_id: r.shared_chars for r in shared_spans.shared_share(df, 60).collect()} == {i: len(c) for i, c in covered.items()}


def _brute_seats(available, target, floor, size, names):
    ranked = sorted((0 if r <= f else 1, 0 if r <= f else (r - 0.5) / t, n, r) for a, t, f, n in zip(available, target, floor, names) for r in range(1, a + 1) if t > 0 or r <= f)
    seats = Counter(n for *_, n, _ in ranked[:size])
    return [seats[n] for n in names]


def test_seats_against_brute_force():
    import numpy as np

    random.seed(9)
    for _ in range(300):
        k = random.randrange(1, 8)
        available, target = [random.randrange(0, 40) for _ in range(k)], [random.choice([0.0, random.random()]) for _ in range(k)]
        floor = [random.randrange(0, 4) if t else 0 for t in target]
        names, size = [chr(97 + i) for i in range(k)], random.randrange(0, 150)
        if sum(min(f, a) for f, a in zip(floor, available)) > size:
            continue
        got = quota_sample.allot(np.array(available), np.array(target), np.array(floor), size, names).tolist()
        assert got == _brute_seats(available, target, floor, size, names)


def test_sample_with_untidy_rows(spark):
    cand = [(1, " Math.A", 0, "p1", "math.A"), (2, "MATH.A ", 1, "p1", "math.A"), (3, None, 2, "p3", "math.a"), (4, "math.A", None, "p4", "math.A"), (5, "b", 0, None, "b"), (6, "b", 0, None, "b"), (7, "c", 0, "p7", "c"), (8, None, 0, "p8", None)]
    c = spark.createDataFrame(cand, "cand_id long, stratum string, rank int, id string, primary_category string").selectExpr("*", "1 as seat", "2 as cat")
    t = spark.createDataFrame([("math.A", 2, 0.6, 1), ("b", 1, 0.3, 1), ("d", 1, 0.1, 1)], "stratum string, n_ai_in_stratum int, target_share double, min_rows int")
    got = quota_sample.quota_sample(c, t, 4).collect()
    assert {(r.stratum, r.cand_id) for r in got} == {("math.a", 1), ("math.a", 3), ("b", 5), ("math.a", 4)}
    report = {r.stratum: r for r in quota_sample.quota_report(c, t, 4).collect()}
    assert report["d"].reason == "no candidates"
    assert report["c"].reason == "no target"
    assert quota_sample.quota_sample(c.limit(0), t).count() == 0
    assert quota_sample.quota_sample(c, t.limit(0)).count() == 0
