import random

import pyarrow as pa
import pytest

from refloom.llm import assignment, edit_metric, entity_match, name_variants
from refloom.llm.edit_metric import distance


def _recursive(a: str, b: str) -> int:
    """The metric by search over edits, for short words."""
    seen, layer, steps = {a}, {a}, 0
    letters = set(a + b)
    while b not in seen:
        steps += 1
        nxt = set()
        for w in layer:
            for i in range(len(w) + 1):
                nxt |= {w[:i] + c + w[i:] for c in letters}
                if i < len(w):
                    nxt |= {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in letters}
                if i + 1 < len(w):
                    nxt.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        layer = nxt - seen
        seen |= layer
    return steps


def test_metric():
    random.seed(1)
    words = ["".join(random.choices("ab", k=random.randrange(0, 5))) for _ in range(40)]
    for _ in range(60):
        a, b = random.choices(words, k=2)
        assert distance(a, b) == _recursive(a, b)
    assert distance("ca", "abc") == 2  # a transposition may be parted
    many = ["".join(random.choices("abc", k=random.randrange(0, 8))) for _ in range(200)]
    for p in many[:10]:
        assert edit_metric.distances(many, p).tolist() == [distance(w, p) for w in many]
    for _ in range(2000):
        a, b, c = random.choices(many, k=3)
        assert distance(a, c) <= distance(a, b) + distance(b, c)


@pytest.mark.parametrize("radius", [1, 2])
def test_radius_join_is_exact(spark, monkeypatch, radius):
    monkeypatch.setattr(edit_metric, "PER_PIVOT", 40)
    random.seed(2)
    words = list({"".join(random.choices("abcde", k=random.randrange(0, 9))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in [*words, words[0], None]], "k string")
    got = {tuple(r) for r in edit_metric.radius_join(df, "k", radius).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and distance(a, b) <= radius}
    assert edit_metric.radius_join(df.limit(0), "k").count() == 0


def test_spellings_of_one_person(spark):
    people = [["Robert L. Kraplin", "Kraplin, R. L.", "B. Kraplin", "Bob Kraplin", "KRAPLIN, Robert", "Kraplin Robert", "Robret Kraplin", "Krapplin, Robert L.", "robert kraplin"], ["Anna M. Zürich", "Zurich, Anna", "A. M. Zuerich"], ["Foo Institute for Bars", "Foo Inst. for Bars", "The Foo Institute for Bars", "Foo Insttute for Bars"], ["Tom Other", "Other, T."]]
    rows = [(i, "f", n) for i, n in enumerate(n for p in people for n in p)] + [(i, "f", p[0]) for i, p in enumerate(people * 5, 100)] + [(998, "f", "Other, Tom"), (999, None, None), (1000, "f", "")]
    cit = spark.createDataFrame(rows, "ref_id long, preprint_folder string, author string").selectExpr("*", "1 as name", "2 as entity")
    flags = spark.createDataFrame([("kraplin", None), ("", " ")], "first_author_cited string, first_author_registered string")
    got = {tuple(r) for r in name_variants.variant_pairs(cit, flags).collect()}
    people[0].append("kraplin")
    people[3].append("Other, Tom")
    assert got == {(a, b) for p in people for a in p for b in p if a < b}
    assert name_variants.variant_pairs(cit.limit(0), flags.limit(0)).count() == 0


def test_links_are_followed_to_their_ends(spark):
    links = [(i, i + 1) for i in range(1, 14)] + [(50, 9), (70, 71)]
    got = {tuple(r) for r in edit_metric.to_roots(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert got == {(i, 14) for i in range(1, 14)} | {(50, 14), (70, 71)}


def test_chains_of_names(spark):
    # families and given names that are each one letter from the next, ever more frequent
    rows = [("Kraplona, Anselm", 1), ("Kraplon, Anselm", 2), ("Kraplonn, Anselm", 4), ("Kraplonnt, Anselm", 8), ("Bruvik, Martina", 1), ("Bruvik, Marttina", 3), ("Bruvik, Marttiina", 9)]
    names = spark.createDataFrame(rows, "name string, n long")
    entity = {r.name: r.entity for r in name_variants.name_entities(names).collect()}
    assert len({entity[n] for n, _ in rows[:4]}) == 1
    assert len({entity[n] for n, _ in rows[4:]}) == 1


def test_one_family_of_many_given_names(spark):
    random.seed(4)
    given = sorted({"".join(random.choices("abcdefghijklmnoprstuv", k=9)).title() for _ in range(50_000)})
    typo = [g[:4] + g[5:] for g in given[:200]]
    names = spark.createDataFrame([(f"Hotname, {g}", 5) for g in given] + [(f"Hotname, {g}", 1) for g in typo], "name string, n long")
    entity = {r.name: r.entity for r in name_variants.name_entities(names).collect()}
    assert len(entity) == len(given) + len(typo)
    assert all(entity[f"Hotname, {t}"] == entity[f"Hotname, {g}"] for g, t in zip(given, typo))
    assert len(set(entity.values())) >= len(given) - 5  # a few of so many are near each other by chance


def test_title_parts():
    assert entity_match.title_parts("{On} <i>big</i> gr&#246;ups: a second look, II") == ("on big groups", "on big groups a second look", 2, "")
    assert entity_match.title_parts("Erratum to: The Big group")[1:] == ("big group", 0, "erratum")
    assert entity_match.title_parts("Review of “The Big group”")[3] == "review"
    assert entity_match.title_parts(None) == ("", "", 0, "")
    assert entity_match.title_likeness("big groups of spheres", "big gruops of spheres") == 1.0
    assert entity_match.title_likeness("big groups of spheres", "big towers of spheres") < 0.6


def _most(edges):
    """The largest total of a one-to-one part, by trying all."""
    if not edges:
        return 0.0
    (a, b, c), rest = edges[0], edges[1:]
    return max(_most(rest), c + _most([e for e in rest if e[0] != a and e[1] != b]))


def test_assignment(spark):
    random.seed(6)
    got_total = want_total = 0.0
    edges = []
    for block in range(12):
        pairs = {(f"u{block}{random.randrange(4)}", 10 * block + random.randrange(4)) for _ in range(7)}
        edges.append([(u, w, round(random.uniform(0.78, 1), 4)) for u, w in pairs])
    df = spark.createDataFrame([e for b in edges for e in b], "left string, right long, c double")
    got = assignment.one_to_one(df).collect()
    assert len({r.left for r in got}) == len({r.right for r in got}) == len(got)
    known = {(u, w): c for b in edges for u, w, c in b}
    assert all(known[r.left, r.right] == r.c for r in got)
    got_total, want_total = sum(r.c for r in got), sum(_most(b) for b in edges)
    assert got_total >= 0.92 * want_total  # dense components, where longer exchanges would help
    swap = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.85), ("b", 1, 0.88)], "left string, right long, c double")
    assert {(r.left, r.right) for r in assignment.one_to_one(swap).collect()} == {("a", 2), ("b", 1)}
    assert assignment.one_to_one(df.limit(0)).count() == 0


def test_works_match(spark):
    cit = [
        (1, "On big groups of spheres", "Ann One and B. Two", "2001", "7", "1-9", "doi:10.1/x"), (2, "on big gruops of spheres.", None, None, None, None, "doi:10.1/X arxiv:9.9"), (3, "Big groups", None, "n.d.", None, None, "arxiv:9.9"),
        (4, "On big groups of spheres, II", "Ann One", "2003", "8", "1-9", "doi:10.1/y"), (5, "On big groups of spheres", "Carl Three", "1980", "2", "5-6", None), (6, None, "Ann One", "2001", "7", "1-9", None), (7, "  ", None, None, None, None, None), (1, "On big groups of spheres", "Ann One and B. Two", "2001", "7", "1-9", "doi:10.1/x"),
    ]
    reg = [(1, "journal-article", "On big <i>groups</i> of spheres", [2001, 2002], "One", "7", "1-9"), (2, "journal-article", "Erratum to: On big groups of spheres", [2001], "One", None, None), (3, "journal-article", "On Big Groups Of Spheres", None, "ONE, A.", None, ""), (4, "journal-article", None, None, None, None, None), (5, "review", "On big groups of spheres", [2001], "One", "7", None), (6, "journal-article", "On tall towers of spheres", [2001], "Nine", None, None)]
    c = spark.createDataFrame(cit, "ref_id long, title string, author string, year string, volume string, pages string, normalized_id string").selectExpr("*", "1 as unit", "2 as main")
    r = spark.createDataFrame(reg, "reg_id long, type string, title string, years array<int>, first_author string, volume string, page string").selectExpr("*", "1 as kind")
    got = entity_match.matches(c, r).collect()
    assert {(x.ref_id, x.reg_id) for x in got} == {(i, j) for i in (1, 2, 3) for j in (1, 3)}
    assert all(0.78 <= x.confidence <= 1 for x in got)
    assert entity_match.matches(c.limit(0), r).count() == entity_match.matches(c, r.limit(0)).count() == 0


def test_windows_of_rows(spark):
    # rows of equal keys, keys of other orders between them, ranges cut anywhere; rows of other years, parts, volumes or pages are left out
    random.seed(7)
    rows = [(f"{random.choice('12')}|w{random.randrange(300):03d}", random.randrange(2), i, y, y, random.randrange(2), random.choice([-1, 1, 2]), random.choice([-1, 3])) for i in range(900) for y in [random.choice([1990, 1991])]]
    df = spark.createDataFrame(rows, "k string, side int, id long, m_lo int, m_hi int, m_part int, m_volume int, m_pages int")
    got = [tuple(r) for r in entity_match.window_pairs(df, len(rows)).collect()]
    want = set()
    for k, side, i, *m in rows:
        keys = sorted({x[0] for x in rows if x[1] == 0 and x[0][0] == k[0]})
        at = sum(x <= k for x in keys)
        near = set(keys[max(0, at - entity_match.WINDOW) : at + entity_match.WINDOW])
        want |= {(i, x[2]) for x in rows if side == 1 and x[1] == 0 and x[0] in near and x[3] == m[0] and x[5] == m[2] and (x[6] == m[3] or -1 in (x[6], m[3]))}
    assert len(got) == len(set(got)) and set(got) == want


def test_citations_are_read_once(spark, tmp_path):
    rows = [(1, "On big groups", "Ann One", "2001", "7", "1-9", "doi:10.1/x arxiv:9.9"), (2, "Big groups", None, None, None, None, "arxiv:9.9"), (3, None, None, None, None, None, "doi:10.1/y arxiv:8.8"), (4, "On tall towers", None, None, None, None, "arxiv:8.8"), (5, " ", None, None, None, None, None)]
    spark.createDataFrame(rows, "ref_id long, title string, author string, year string, volume string, pages string, normalized_id string").write.parquet(f"{tmp_path}/c")
    units, found = entity_match.cited_units(spark.read.parquet(f"{tmp_path}/c"))
    assert {tuple(r) for r in found.collect()} == {(1, "d:101x"), (2, "d:101x"), (4, "d:101y")}
    assert {r.unit for r in units.collect()} == {"d:101x", "d:101y"}
    assert not any(str(tmp_path) in f for f in [*found.inputFiles(), *units.inputFiles()])


def test_metric_without_common_ends():
    random.seed(8)
    for _ in range(300):
        a, b = ("".join(random.choices("ab", k=random.randrange(0, 5))) for _ in range(2))
        x, y = ("".join(random.choices("ab", k=random.randrange(0, 2))) for _ in range(2))
        assert distance(x + a + y, x + b + y) == _recursive(x + a + y, x + b + y)
    assert distance("a" * 20_000 + "bc", "a" * 20_000 + "cb") == 1


def test_each_pair_meets_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(edit_metric, "PER_PIVOT", 40)
    random.seed(9)
    words = list({"".join(random.choices("abcd", k=random.randrange(0, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "k string")
    written = {}
    staged = edit_metric.staged
    monkeypatch.setattr(edit_metric, "staged", lambda d, name: written.setdefault(name, staged(d, name)))
    got = {tuple(r) for r in edit_metric.radius_join(df, "k", 1).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and distance(a, b) <= 1}
    cells = written["cells"].collect()
    home = {r.key: r.cell for r in cells if r.home}
    assert len(home) == len(words) and len(set(home.values())) > 1
    assert all(r.cell > home[r.key] for r in cells if not r.home)  # never to an earlier cell


def test_hashed_deletion_forms_are_those_of_the_texts():
    keys = ["", "a", "ab", "aab", "abab", "ba", "xaab", "bbb", "\U0001f600b", "é"]
    for radius in (0, 1, 2):
        who, hashes = edit_metric.deletion_forms(keys, radius)
        forms = lambda k: {k} if radius == 0 else {k[:i] + k[i + 1 :] for i in range(len(k))} | {k}
        of = [set(forms(k)) if radius < 2 else {f for g in forms(k) for f in forms(g)} for k in keys]
        got = [set(hashes[who == i].tolist()) for i in range(len(keys))]
        assert [len(g) for g in got] == [len(f) for f in of]
        assert all(len(got[i] & got[j]) == len(of[i] & of[j]) for i in range(len(keys)) for j in range(len(keys)))


def test_pairs_of_a_form_that_goes_on_in_the_next_batch():
    words = ["ab", "ac", "ad", "zz", "ae", "q", "qr"]
    forms = [1, 1, 1, 1, 1, 2, 3]
    home = [False, True, False, True, False, True, True]
    batches = [pa.RecordBatch.from_pydict({"form": pa.array(forms[i : i + k], pa.int64()), "key": words[i : i + k], "home": home[i : i + k]}) for i, k in ((0, 2), (2, 0), (2, 1), (3, 3), (6, 1))]
    got = [p for b in edit_metric._near(1)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == [("ab", "ac"), ("ac", "ad"), ("ac", "ae")]
