import json
import random

import numpy as np
import pytest
import tiktoken

from refloom.llm import bpe, mix_pack

RANKS = bpe.read_ranks(f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_the_library_s(oracle):
    random.seed(3)
    enc = bpe.Encoder(RANKS)
    pool = [*map(chr, range(1, 0x180)), *"  \n\t\r\u0085  ​'’αΛжﬁ格🙂½²Ⅷ٣́", "'s", "'re", " the", "\\cite{"]
    texts = ["", " ", "\n\n", "<|endoftext|>", "a" * 4000, "ab" * 900, "é" * 700, " " * 500, *("".join(random.choices(pool, k=random.randrange(1, 80))) for _ in range(1500))]
    for t in texts:
        assert list(enc.ids(t)) == oracle.encode_ordinary(t)


def test_long_words_take_the_same_ids(oracle):
    random.seed(4)
    for n in (161, 700, 5000):
        word = "".join(random.choices("etaoinshrdlu", k=n))
        assert list(bpe._encode_long(word.encode(), RANKS)) == oracle.encode_ordinary(word)


def test_operator(spark):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", None), (1, "Hello  world", "x"), (None, "a", "x")]
    got = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == 5
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert all(bytes().join(k for i in r.ids for k, v in RANKS.items() if v == i) == b"Hello  world" for r in got if r.doc_id == 1)
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack_window_is_whole_and_tight():
    random.seed(5)
    sizes = np.array([random.randrange(0, 101) for _ in range(2000)])
    into = mix_pack.pack_window(sizes, 100)
    used = np.bincount(into, weights=sizes)
    assert used.max() <= 100
    assert len(used) <= np.ceil(sizes.sum() / 100) * 1.02 + 1
    assert mix_pack.pack_window(np.array([], dtype=int), 10).tolist() == []


def _items(spark):
    random.seed(6)
    rows = [(i, random.choice("aab"), random.choice([0, 3, 50, 250, 990])) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), rows


def test_packing_keeps_everything_and_the_mixture(spark):
    items, rows = _items(spark)
    caps = spark.createDataFrame([(1, 100), (2, 400), (3, 0), (4, None)], "capacity_id int, capacity_tokens int")
    packed = mix_pack.pack_items(items, caps, window_tokens=20_000).toPandas()
    assert set(packed.capacity_id) == {1, 2}
    for cap, part in packed.groupby("capacity_tokens"):
        assert part.n_tokens.sum() == sum(n for *_, n in rows)
        assert part.groupby(["window", "container"]).n_tokens.sum().max() <= cap
        whole = part.groupby("doc_id").agg(n=("n_tokens", "sum"), pieces=("piece", "count"))
        want = {i: (n, max(1, -(-n // cap))) for i, _, n in rows}
        assert {i: (r.n, r.pieces) for i, r in whole.iterrows()} == want
        shares = part.groupby(["window", "source"]).n_tokens.sum().unstack(fill_value=0)
        total = shares.sum() / shares.sum().sum()
        full = shares.iloc[:-1]
        assert (full.div(full.sum(axis=1), axis=0) - total).abs().max().max() < 0.1
        assert (full.cumsum().sub(np.outer(np.arange(1, len(full) + 1), total.to_numpy() * 20_000))).abs().max().max() < 1000  # deficits stay below an item


def test_windows_stay_full_when_a_source_runs_out(spark):
    random.seed(7)
    rows = [(i, "big" if i % 3 else "small", random.randrange(0, 60)) for i in range(6000)] + [(10_000 + i, "empty", 0) for i in range(500)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    packed = mix_pack.pack_items(items, caps, {"big": 1.0, "small": 1.0}, 10_000)
    shares = packed.toPandas().groupby(["window", "source"]).n_tokens.sum().unstack(fill_value=0)
    total = shares.sum(axis=1)
    assert len(shares) > 14
    assert (total.iloc[:-1] - 10_000).abs().max() < 130  # an item of each source
    both = int(shares["small"].sum() // 5000)
    assert both < len(shares) - 3  # the small source runs out well before the end
    assert (shares["small"].iloc[:both] - 5000).abs().max() < 130
    assert shares["small"].iloc[both + 1 :].sum() == 0
    fault = mix_pack.packing_faults(items, packed, caps, 10_000).first()
    assert (fault["items"], fault.split_items, fault.changed_items, fault.overfull, fault.uneven_windows) == (6500, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="positive"):
        mix_pack.pack_items(items, caps, {"big": 0.0})


def test_packing_follows_targets_and_takes_empty_tables(spark):
    items, _ = _items(spark)
    caps = spark.createDataFrame([(1, 400)], "capacity_id int, capacity_tokens int")
    first = mix_pack.mixture_report(mix_pack.pack_items(items, caps, {"a": 1.0, "b": 1.0}, 20_000)).where("window = 0").toPandas()
    assert (first.share - 0.5).abs().max() < 0.06
    assert mix_pack.pack_items(items.limit(0), caps).count() == 0
    assert mix_pack.pack_items(items, caps.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "s", "x"), (2, "word " * 1000, "s", "x")], "doc_id long, text string, source string, window string")
    got = mix_pack.pack_texts(docs, caps).toPandas()
    assert json.loads(got[got.n_tokens == 0].source.sort_values().to_json(orient="values")) == ["", "s"]
    assert got.n_tokens.max() <= 400
