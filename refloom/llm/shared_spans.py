"""Long exact spans shared between texts, by fixed-block anchors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.class_pairs import class_join
from refloom.session import skew_join, staged

#: Bits of the filter for each block of the corpus; about 1.5 % of the windows pass it in vain, whatever the corpus.
BITS_PER_BLOCK = 16
#: Bits of the filter that every task holds at a time, 2**30 are 128 MiB. Larger filters are worked through in ranges of the hash.
MOST_BITS = 30
_CHUNK = 1 << 16  # bytes of the filter that one row carries
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RUNS = "hash long, doc_id long, first int, last int, step int, left long, right long, left_last long, right_last long, block boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Prefix sums of one batch of texts, from which the hash of any window comes in constant time."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(codes)
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.down = np.full(n + 1, _INVERSE, dtype=np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * power[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray | slice, length: int) -> np.ndarray:
        """Of the windows of ``length`` that begin at ``at`` in the joined batch."""
        if isinstance(at, slice):
            raw = (self.sums[at.start + length : at.stop + length] - self.sums[at]) * self.down[at]
        else:
            raw = (self.sums[at + length] - self.sums[at]) * self.down[at]
        return _mix(raw)

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and joined position of the non-overlapping blocks."""
        n = self.sizes // length
        text = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return text, self.starts[text] + within * length

    def ends(self) -> np.ndarray:
        """For each joined position, where its text ends."""
        return np.repeat(self.starts[1:], self.sizes)


def _batches(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of a batch in parts of so many characters, each text whole."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def filter_size(docs: DataFrame, length: int) -> tuple[int, int]:
    """(bits as a power of two, ranges as a power of two): the size of one range's filter and into how many ranges of the hash the blocks of ``docs`` are cut."""
    blocks = docs.agg(F.coalesce(F.sum(F.floor(F.length("text") / length)), F.lit(0))).first()[0]
    bits = max(16, (max(1, blocks) * BITS_PER_BLOCK - 1).bit_length())
    return min(bits, MOST_BITS), max(0, bits - MOST_BITS)


def _in_range(hashes: np.ndarray, ranges: int, at: int) -> np.ndarray:
    return (hashes & np.uint64((1 << ranges) - 1)) == np.uint64(at)


def block_filter(docs: DataFrame, length: int, bits: int, ranges: int = 0, at: int = 0) -> np.ndarray:
    """A Bloom filter of the hashes, in range ``at`` of 2**``ranges``, of all non-overlapping blocks.

    Every task passes on which bits its blocks set, the bits of a chunk are put
    together in the cluster, and only the finished filter of 2**``bits`` bits, at
    most ``MOST_BITS``, reaches the driver.
    """
    chunk_bits = min(_CHUNK * 8, 1 << bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch):
                r = Rolling(texts)
                h = r.hashes(r.blocks(length)[1], length)
                slots = np.unique(np.concatenate(_slots(h[_in_range(h, ranges, at)], bits)))
                chunk, offset = slots // np.uint64(chunk_bits), (slots % np.uint64(chunk_bits)).astype(np.uint32)
                used, starts = np.unique(chunk, return_index=True)
                parts = np.split(offset, starts[1:]) if len(used) else []
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "data"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(chunk_bits, dtype=bool)
        for d in pdf["data"]:
            own[np.frombuffer(d, dtype=np.uint32)] = True
        return pd.DataFrame({"chunk": [pdf["chunk"].iat[0]], "data": [zlib.compress(np.packbits(own).tobytes(), 1)]})

    out = np.zeros((1 << bits) // 8, dtype=np.uint8).reshape(-1, chunk_bits // 8)
    for row in docs.select("doc_id", "text").mapInArrow(mark, "chunk long, data binary").groupBy("chunk").applyInPandas(unite, "chunk long, data binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
    return out.reshape(-1)


def block_runs(docs: DataFrame, length: int, bits: int, ranges: int = 0, at: int = 0) -> DataFrame:
    """The rolling windows whose hash passes the filter of blocks, one row for each run: (hash, doc_id, first, last, step, contexts, block).

    A run is a text's places with one hash, each at most half a window after the
    one before, as in text that repeats itself; by the theorem of Fine and Wilf
    they are ``step`` apart. Nearly all runs are one window (``step`` 0). ``left``
    and ``right`` hash the half-length contexts before and after the first window,
    ``left_last`` and ``right_last`` those of the last one where it is another; null
    where the text is too short. ``block`` tells whether one of the windows is a block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block_filter(docs, length, bits, ranges, at))
    half = length // 2

    def context(r: Rolling, at: np.ndarray, ok: np.ndarray) -> pa.Array:
        out = np.zeros(len(at), dtype=np.int64)
        out[ok] = r.hashes(at[ok], half).view(np.int64)
        return pa.array(out, mask=~ok)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        bit = lambda slot: (bitmap[slot >> np.uint64(3)] & (np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8))) != 0
        for batch in batches:
            for ids, texts in _batches(batch):
                r = Rolling(texts)
                if r.starts[-1] < length:
                    continue
                h = r.hashes(slice(0, int(r.starts[-1]) - length + 1), length)
                hit = np.flatnonzero(bit(h >> np.uint64(64 - bits)))
                if ranges:
                    hit = hit[_in_range(h[hit], ranges, at)]
                hit = hit[bit(_slots(h[hit], bits)[1])]
                text = np.searchsorted(r.starts, hit, side="right") - 1
                inside = hit + length <= r.starts[text + 1]
                hit, text = hit[inside], text[inside]
                order = np.lexsort((hit, h[hit], text))
                hit, text = hit[order], text[order]
                same = (np.diff(h[hit].view(np.int64)) == 0) & (np.diff(text) == 0) & (np.diff(hit) <= half)
                begins = np.flatnonzero(np.concatenate([[True], ~same])) if len(hit) else np.array([], dtype=np.int64)
                ends = np.concatenate([begins[1:], [len(hit)]]) - 1 if len(hit) else begins
                first, last, text = hit[begins], hit[ends], text[begins]
                step = np.zeros(len(first), dtype=np.int64)
                several = ends > begins
                step[several] = hit[begins[several] + 1] - first[several]
                block = np.add.reduceat(((hit - r.starts[np.repeat(text, ends - begins + 1)]) % length == 0).astype(np.int64), begins) > 0 if len(begins) else np.array([], dtype=bool)
                start, end = r.starts[text], r.starts[text + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[first].view(np.int64)), pa.array(np.asarray(ids, dtype=np.int64)[text]), *(pa.array((x).astype(np.int32)) for x in (first - start, last - start, step)),
                        context(r, first - half, first - start >= half), context(r, first + length, first + length + half <= end),
                        context(r, last - half, several & (last - start >= half)), context(r, last + length, several & (last + length + half <= end)), pa.array(block),
                    ],
                    [c.split()[0] for c in _RUNS.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(probe, _RUNS)


def _common(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The exact number of characters by which each run extends to both sides."""

    def left(a: str, b: str) -> int:
        n = min(len(a), len(b))
        k = 0
        while k < n and a[-1 - k] == b[-1 - k]:
            k += 1
        return k

    def right(a: str, b: str) -> int:
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        return k

    for pdf in pdfs:
        before = [left(a, b) for a, b in zip(pdf["a_before"], pdf["b_before"])]
        after = [right(a, b) for a, b in zip(pdf["a_after"], pdf["b_after"])]
        same = pdf["a_text"] == pdf["b_text"]
        out = pdf[["doc_a", "start_a", "doc_b", "start_b", "length"]].assign(before=before, after=after)[same]
        yield pd.DataFrame({"doc_a": out.doc_a, "start_a": out.start_a - out.before, "doc_b": out.doc_b, "start_b": out.start_b - out.before, "length": out.length + out.before + out.after})


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, rep): the smallest doc_id that has the row's text. A frequent text is counted before any row is shuffled."""
    keyed = staged(docs.select("doc_id", F.sha2("text", 256).alias("same")), "same")
    least = keyed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = skew_join(keyed, staged(least, "least"), ["same"], "n", keyed.count(), "left")
    return several.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def _diagonals(pairs: DataFrame, length: int) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b): the blocks of doc_a whose window lies in both runs of a pair, on the diagonals that can carry a longest span.

    Those align the runs' first or last windows, exactly or one period off;
    without repetition they are one.
    """
    fa, fb, la, lb, pa_, pb = (F.col(c) for c in ("first_a", "first_b", "last_a", "last_b", "step_a", "step_b"))
    off_a, off_b = F.when(la > fa, pa_).otherwise(0), F.when(lb > fb, pb).otherwise(0)
    shifts = F.array_distinct(F.array(fb - fa, lb - la, fb - fa - off_a, fb - fa + off_b, lb - la + off_a, lb - la - off_b))
    each = pairs.select("doc_a", "doc_b", "first_a", "last_a", "step_a", "first_b", "last_b", F.explode(shifts).alias("shift"))
    low, high = F.greatest(fa, fb - F.col("shift")), F.least(la, lb - F.col("shift"))
    from_ = F.ceil(low / length).cast("int") * length
    places = F.when(from_ <= high, F.filter(F.sequence(from_, high, F.lit(length)), lambda x: F.when(pa_ > 0, (x - fa) % pa_ == 0).otherwise(True))).otherwise(F.array().cast("array<int>"))
    blocks = each.select("doc_a", "doc_b", "shift", F.explode(places).alias("start_a"))
    return blocks.select("doc_a", "start_a", "doc_b", (F.col("start_a") + F.col("shift")).alias("start_b")).distinct()


def shared_spans(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b, length): the maximal spans of ``least`` or more characters common to two different texts.

    doc_a < doc_b, starts from 0, in code points. Any such span covers one of
    doc_a's blocks of ``least`` // 2 characters whole, so the blocks of doc_a are
    looked up among the rolling windows of doc_b, consecutive blocks on one
    diagonal become a run, and a run is extended character by character at both
    ends. A pair is formed only where half a block of context agrees too, so a
    frequent short phrase forms none. Where both texts repeat themselves with a
    period of up to half a block, only the alignments of their ends are listed
    (and those one period off), not every shift by a period. Texts that are
    equal are represented by the smallest doc_id; :func:`span_pairs` brings the
    others back. Texts below ``least`` characters and null texts share nothing.
    doc_id must be unique and not null.
    """
    texts = docs.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _spans(texts, _run_pairs(texts, staged(representatives(texts), "reps"), least), least)


def _run_pairs(texts: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(doc_a, first_a, last_a, step_a, doc_b, ...): runs of two different texts, one of them with a block, that agree in hash and a context."""
    length = least // 2
    bits, ranges = filter_size(texts, length)
    hits = None
    for at in range(1 << ranges):
        one = staged(block_runs(texts, length, bits, ranges, at), "hits")
        hits = one if hits is None else hits.unionByName(one)
    # only hashes that lie in more than one document, as a block in at least one
    useful = hits.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("block").alias("block"), F.count(F.lit(1)).alias("n")).where("low < high and block").select("hash", "n")
    useful = staged(useful, "hashes")
    total = useful.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = skew_join(hits, useful, ["hash"], "n", total)
    hits = staged(hits.join(reps.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), "useful")

    sides = F.array_distinct(F.filter(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("context")) for side, c in ((0, "left"), (1, "right"), (0, "left_last"), (1, "right_last")))), lambda x: x["context"].isNotNull()))
    keyed = hits.withColumn("key", F.explode(sides)).select("hash", "key.side", "key.context", "doc_id", "first", "last", "step", "block")
    own = lambda d, x: d.select("hash", "side", "context", *(F.col(c).alias(f"{n}_{x}") for c, n in (("doc_id", "doc"), ("first", "first"), ("last", "last"), ("step", "step"))))
    pairs = class_join(own(keyed.where("block"), "a"), own(keyed, "b"), ["hash", "side", "context"], "doc_a", "doc_b").where("doc_a < doc_b")
    return pairs.select(*(f"{n}_{x}" for x in "ab" for n in ("doc", "first", "last", "step"))).distinct()


def _spans(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    length = least // 2
    pairs = _diagonals(pairs, length)
    # runs of consecutive blocks on a diagonal
    w = W.partitionBy("doc_a", "doc_b", "diagonal").orderBy("start_a")
    runs = pairs.withColumn("diagonal", F.col("start_b") - F.col("start_a"))
    runs = runs.withColumn("new", F.when(F.col("start_a") - F.lag("start_a").over(w) == length, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("doc_a", "doc_b", "diagonal", "run").agg(F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), (F.max("start_a") - F.min("start_a") + length).alias("length"))
    runs = staged(runs, "runs")

    # the characters of each run and around it, cut from the text where the text lies
    places = runs.select(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("start"), "length").union(runs.select("doc_b", "start_b", "length")).distinct()
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    cut = texts.join(places, "doc_id").select("doc_id", "text", F.explode("places").alias("p"))
    s, n = F.col("p.start"), F.col("p.length")
    cut = cut.select(
        "doc_id", s.alias("start"), n.alias("length"), F.substring("text", F.greatest(s - length, F.lit(0)) + 1, F.least(s, F.lit(length))).alias("before"), F.sha2(F.substring("text", s + 1, n), 256).alias("text"), F.substring("text", s + n + 1, F.lit(length)).alias("after")
    )
    cut = staged(cut, "cut")
    side = lambda x: cut.select(F.col("doc_id").alias(f"doc_{x}"), F.col("start").alias(f"start_{x}"), "length", F.col("before").alias(f"{x}_before"), F.col("text").alias(f"{x}_text"), F.col("after").alias(f"{x}_after"))
    whole = runs.select("doc_a", "start_a", "doc_b", "start_b", "length").join(side("a"), ["doc_a", "start_a", "length"]).join(side("b"), ["doc_b", "start_b", "length"])
    spans = whole.mapInPandas(_common, "doc_a long, start_a int, doc_b long, start_b int, length int")
    return spans.where(F.col("length") >= least)


def span_pairs(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id_a, doc_id_b): every two documents, a < b, with a common span of ``least`` or more characters; equal texts included."""
    texts = docs.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps = staged(representatives(texts), "reps")
    pairs = staged(_spans(texts, _run_pairs(texts, reps, least), least).select("doc_a", "doc_b").distinct(), "between")
    members = reps.select(F.col("doc_id").alias("x"), F.col("rep").alias("doc_a"))
    others = reps.select(F.col("doc_id").alias("y"), F.col("rep").alias("doc_b"))
    # most texts are their own representative: only pairs of texts that have copies are joined with them
    first = class_join(pairs, members, ["doc_a"], "doc_b", "x").select("x", "doc_b")
    between = class_join(staged(first, "first"), others, ["doc_b"], "x", "y").select("x", "y")
    copied = staged(reps.join(reps.where("doc_id <> rep").select("rep").distinct(), "rep", "left_semi"), "copied")
    within = class_join(copied.select(F.col("doc_id").alias("x"), "rep"), copied.select(F.col("doc_id").alias("y"), "rep"), ["rep"], "x", "y").where("x < y").select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_share(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, n_chars, n_copies, shared_chars, shared_share): how much of each text lies elsewhere too, one row per row of ``docs``.

    A text that another row repeats whole is shared whole if it has ``least`` or
    more characters. A null text has null n_chars and share, an empty one share 0.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps = staged(representatives(texts), "reps")
    texts = texts.where(F.length("text") >= least)
    pairs = staged(_run_pairs(texts, reps, least), "pairs")
    spans = _spans(texts, pairs, least)
    both = spans.select(F.col("doc_a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).union(spans.select("doc_b", "start_b", F.col("start_b") + F.col("length")))
    # two repeating stretches match under every shift by a period, so they are shared whole
    length = least // 2
    whole = pairs.where((F.col("step_a") > 0) & (F.col("step_b") > 0) & (F.least(F.col("last_a") - F.col("first_a"), F.col("last_b") - F.col("first_b")) + length >= least))
    both = both.union(whole.select("doc_a", "first_a", F.col("last_a") + length)).union(whole.select("doc_b", "first_b", F.col("last_b") + length))
    both = both.groupBy("rep", "s").agg(F.max("e").alias("e"))  # no more rows of a text than it has characters
    w = W.partitionBy("rep").orderBy("s", "e")
    before = F.coalesce(F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = both.withColumn("gain", F.greatest(F.col("e") - F.greatest(F.col("s"), before), F.lit(0))).groupBy("rep").agg(F.sum("gain").alias("covered"))
    known = staged(reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies")).join(covered, "rep", "left").select("rep", "n_copies", F.col("n_copies").alias("n"), "covered"), "known")
    of_text = skew_join(reps, known, ["rep"], "n", reps.count(), "left")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars")).join(of_text, "doc_id", "left")
    shared = F.when((F.col("n_copies") > 1) & (F.col("n_chars") >= least), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select("doc_id", "n_chars", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), shared.cast("long").alias("shared_chars"), F.when(F.col("n_chars").isNotNull(), F.coalesce(F.round(F.try_divide(shared, "n_chars"), 6), F.lit(0.0))).alias("shared_share"))
