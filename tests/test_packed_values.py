from collections import Counter

import pyarrow as pa
import pytest

from refloom import session
from refloom.functions.packed import first_value, values
from refloom.operators import packed_values
from refloom.operators.packed_values import delimiter_scores, split_multi, split_packed, value_counts

NAMES = [
    ("A. One; B. Two", ["A. One", "B. Two"]), ("One, A., Two, B. C.", ["One, A.", "Two, B. C."]), ("One, Ann and Two, Bob", ["One, Ann", "Two, Bob"]), ("One, Ann", ["One, Ann"]), ("A. One, B. Two & C. Three", ["A. One", "B. Two", "C. Three"]),
    ("A. One, and B. Two; et al.", ["A. One", "B. Two"]), ("A. One and others", ["A. One"]), ("{Group on X and Y}; A. One", ["Group on X and Y", "A. One"]), ('"One, A."; "Two, B."', ["One, A.", "Two, B."]), ("Foo University, Department of Bars and One, Ann", ["Foo University, Department of Bars", "One, Ann"]),
    ("A. One\nB. Two", ["A. One", "B. Two"]), ("A. One / B. Two", ["A. One", "B. Two"]), ("A. One AND B. Two", ["A. One", "B. Two"]), ("", []), ("  ;; ", []), ("et al.", []), ("Ann One,Bob Two", ["Ann One", "Bob Two"]),
]


@pytest.mark.parametrize(("field", "want"), NAMES)
def test_names(field, want):
    assert values(field, "name") == want


def test_first_value_is_the_first_of_all():
    for field, want in NAMES:
        if want:
            assert first_value(field) == want[0]


@pytest.mark.parametrize(("field", "want"), [("['a.B', 'c.D']", ["a.B", "c.D"]), (" a.B,,c.D,", ["a.B", "c.D"]), ('a.B; c-d; "11F, 22E"', ["a.B", "c-d", "11F, 22E"]), ("a.B;c.D / e.F", ["a.B", "c.D", "e.F"]), ("a.B c.D  14C20 ", ["a.B", "c.D", "14C20"]), ("[]", []), ("a.B", ["a.B"])])
def test_codes(field, want):
    assert values(field, "code") == want


def test_operator_handles_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "f", "A. One; B. Two", 9), (1, "f", "A. One; B. Two", 9), (2, None, None, 9), (3, "f", "", 9), (4, None, "One, Ann", 9), (None, "g", "A. One and B. Two", 9), (5, "f", "A. One; " * 3000 + "B. Two", 9)]
    df = spark.createDataFrame(rows, "ref_id long, preprint_folder string, author string, pos int")
    got = split_multi(df, "ref_id", "author", "preprint_folder").collect()
    assert sorted((r.row_id, r.pos, r.val) for r in got if r.row_id == 1) == [(1, 1, "A. One")] * 2 + [(1, 2, "B. Two")] * 2
    assert {r.row_id for r in got} == {1, 5, None}
    assert max(r.pos for r in got if r.row_id == 5) == 3001
    assert ("One, Ann") in {r.val for r in split_packed(df, "ref_id", "author", "preprint_folder").collect()}
    assert split_multi(df.limit(0), "ref_id", "author", "preprint_folder").count() == 0


def test_sources_decide(spark):
    odd = "x one; w two and z three"  # no cut gives values throughout
    rows = [(i, "bodies", "Group of A and B; C. Dee") for i in range(20)] + [(i, "mixed", "A. One; B. Two and C. Three") for i in range(20)] + [(98, "bodies", odd), (99, "mixed", odd)]
    got = split_multi(spark.createDataFrame(rows, "id long, s string, a string"), "id", "a", "s").where("row_id >= 98").orderBy("row_id", "pos").collect()
    assert [r.val for r in got if r.row_id == 98] == ["x one", "w two and z three"]
    assert [r.val for r in got if r.row_id == 99] == ["x one", "w two", "z three"]


def test_scores_of_a_source_and_shape(spark):
    rows = [("s", "code", "a.B;c.D e.F"), ("s", "code", "a.B;c.D"), ("s", "code", "a.B;c.D")]
    scores = {(r.shape, r.cand): r.score for r in delimiter_scores(spark.createDataFrame(rows, "source string, kind string, field string")).where("cand <> ''").collect()}
    assert scores["semicolon", "semicolon"] == 1
    assert scores["semicolon+space", "semicolon+space"] == 1 > scores["semicolon+space", "semicolon"] == scores["semicolon+space", "space"] == 0.5


def test_many_quoted_parts_and_hot_sources(spark, monkeypatch):
    many = "; ".join(f'"Part {i}, of; it"' for i in range(70_000))
    assert values(many, "name") == [f"Part {i}, of; it" for i in range(70_000)]
    monkeypatch.setattr(packed_values, "skew_join", lambda *a: session.skew_join(*a, least=2))
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}", f"A. One; B. Two{i}") for i in range(60)], "id long, s string, a string")
    assert {(r.row_id, r.pos, r.val) for r in split_multi(df, "id", "a", "s").collect()} == {x for i in range(60) for x in ((i, 1, "A. One"), (i, 2, f"B. Two{i}"))}


def test_only_choices_are_scored(spark):
    rows = [(1, "a", "A. One; B. Two"), (2, "a", "A. One, B. Two"), (3, "a", "One, A.; Two, B."), (4, "b", "A. One and B. Two"), (5, "a", "A. One")]
    fields = spark.createDataFrame([(s, "name", f) for _, s, f in rows], "source string, kind string, field string")
    every, some = ({(r.source, r.shape, r.cand): (r.n, r.score) for r in delimiter_scores(fields, least).collect()} for least in (1, 2))
    assert some == {k: v for k, v in every.items() if k[2] == "" or "+" in k[1]} and len(some) < len(every)
    got = {(r.row_id, r.pos, r.val) for r in split_packed(spark.createDataFrame(rows, "ref_id long, src string, author string"), "ref_id", "author", "src").collect()}
    assert got == {(1, 1, "A. One"), (1, 2, "B. Two"), (2, 1, "A. One"), (2, 2, "B. Two"), (3, 1, "One, A."), (3, 2, "Two, B."), (4, 1, "A. One"), (4, 2, "B. Two"), (5, 1, "A. One")}


def test_values_counted_in_one_pass_are_those_of_the_split(spark, monkeypatch):
    odd = "x one; w two and z three"  # its source decides
    rows = [(i, "bodies", "Group of A and B; C. Dee") for i in range(20)] + [(i, "mixed", "A. One; B. Two and C. Three") for i in range(20)] + [(98, "bodies", odd), (99, "mixed", odd), (99, "mixed", odd)]
    rows += [(i, "f", field) for i, (field, _) in enumerate(NAMES, 200)] + [(300, None, odd), (301, "f", None), (302, None, "One, Ann")]
    df = spark.createDataFrame(rows, "ref_id long, s string, a string").repartition(3)
    want = Counter(r.val for r in split_packed(df, "ref_id", "a", "s").collect())
    assert {"w two and z three", "w two", "z three"} <= set(want)
    got = Counter()
    for r in value_counts(df, "a", "s").collect():
        got[r.val] += r.n
    assert got == want
    assert value_counts(df.limit(0), "a", "s").count() == 0
    # a field is cut once, for its scores and its values
    reads, field = [], packed_values.Field
    monkeypatch.setattr(packed_values, "Field", lambda text, kind: reads.append(text) or field(text, kind))
    batch = pa.RecordBatch.from_pydict({"source": ["s"] * 3, "field": ["A. One; B. Two, C. Three", odd, odd]})
    (out,) = packed_values._cut("name")(iter([batch]))
    assert reads == ["A. One; B. Two, C. Three", odd]
    assert [(r["part"], r["val"], r["n"]) for r in out.to_pylist()] == [("value", "A. One", 1), ("value", "B. Two", 1), ("value", "C. Three", 1), ("unsure", odd, 2), ("own", None, None), ("all", None, None)]
    # a task that keeps account of few values at once loses nothing
    monkeypatch.setattr(packed_values, "KEPT", 2)
    parts = [r for b in packed_values._cut("name")(iter([batch, batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in parts if r["part"] == "unsure") == 4 and sum(r["n"] for r in parts if r["val"] == "B. Two") == 2
    assert all(sum(x["n"] for r in parts if r["part"] == part for x in r["sums"] if x["cand"] == "") == 6 for part in ("own", "all"))
