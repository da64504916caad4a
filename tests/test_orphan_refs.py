import datetime as dt
import random

import numpy as np

from refloom.operators.orphan_refs import Bits, corpus_orphans, orphans_by_table_and_period


def test_bits_against_sets():
    random.seed(1)
    for n in (0, 5, 4096, 30_000):
        a, b = (set(random.sample(range(65536), n)) for _ in range(2))
        x, y = Bits(np.array(sorted(a))), Bits(np.array(sorted(b)))
        assert set(x.and_not(y).decode().tolist()) == a - b
        assert set(x.union(y).decode().tolist()) == a | b


def _at(day: int) -> dt.datetime:
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def _brute(ai, cit, cross):
    clean = lambda k: (k or "").strip() or None
    out = set()
    for tab, rows in (("ai_intext_citations", cit), ("ai_cross_citations", cross)):
        for i, f, k, t in rows:
            if f is None or not clean(k) or t is None:
                continue
            own = [(a, r) for _, g, q, _, a, r in ai if g == f and clean(q) == clean(k) and a is not None]
            if not any(a <= t and (r is None or r > t) for a, r in own):
                out.add((tab, i, f"{t:%Y-%m}", "absent" if not own else "late" if all(a > t for a, _ in own) else "removed"))
    named = {(f, clean(k)) for _, f, k, _ in cit}
    for i, f, k, used, a, _ in ai:
        if used == "yes" and f is not None and clean(k) and a is not None and (f, clean(k)) not in named:
            out.add(("ai_citations", i, f"{a:%Y-%m}", "uncited"))
    return out


def _frames(spark, ai, cit, cross):
    return (
        spark.createDataFrame(ai, "ref_id long, preprint_folder string, cite_key string, cited_in_text string, loaded_at timestamp_ntz, removed_at timestamp_ntz"),
        spark.createDataFrame(cit, "cit_id long, paper_id string, key string, extracted_at timestamp_ntz"),
        spark.createDataFrame(cross, "xref_id long, citing_folder string, cite_key string, linked_at timestamp_ntz"),
    )


def test_against_brute_force(spark):
    random.seed(7)
    key = lambda: random.choice([None, "", " ", *[f"{s}k{random.randrange(30)}{s}" for s in ("", " ")]])
    folder = lambda: random.choice(["f", "f", "g", None])
    ai = [(i, folder(), key(), random.choice(["yes", "no", None]), _at(random.randrange(120)), random.choice([None, None, _at(random.randrange(120))])) for i in range(150)]
    cit = [(i, folder(), key(), random.choice([None, *[_at(random.randrange(120))] * 9])) for i in range(400)]
    cross = [(i, folder(), key(), _at(random.randrange(120))) for i in range(80)]
    got = corpus_orphans(*_frames(spark, ai, cit, cross)).collect()
    assert {tuple(r) for r in got} == _brute(ai, cit, cross)
    assert len(got) == len({tuple(r) for r in got})


def test_hot_key_and_empty_tables(spark, monkeypatch):
    import refloom.operators.orphan_refs as o

    real = o.skew_join
    monkeypatch.setattr(o, "skew_join", lambda *a, **k: real(*a, **(k | {"least": 10})))
    ai = [(1, "f", "k", "yes", _at(40), None)]
    cit = [(i, "f", "k", _at(i % 60)) for i in range(300)] + [(1000 + i, "f", "gone", _at(3)) for i in range(200)]
    frames = _frames(spark, ai, cit, [])
    assert {tuple(r) for r in corpus_orphans(*frames).collect()} == _brute(ai, cit, [])
    empty = [f.limit(0) for f in frames]
    assert corpus_orphans(*empty).count() == 0
    assert orphans_by_table_and_period(corpus_orphans(*frames)).agg({"n": "sum"}).first()[0] == len(_brute(ai, cit, []))
