"""Byte-level BPE of a public vocabulary, encoded over the whole corpus."""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function that reads one.
VOCABULARIES = os.environ.get("REFLOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same over texts of ASCII, Latin, Greek and Cyrillic letters and common punctuation, where the standard library's matcher is faster.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0388-\u038a\u038e-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u052f"
_SIGNS = "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u0300-\u036f\u2010-\u2027\u2030-\u205e\u2190-\u22ff"
_SIMPLE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers; beyond it the memory is begun anew.
REMEMBERED = 300_000
#: Up to so many bytes the rank array is scanned; a longer word keeps its candidate pairs in a heap.
SHORT = 160


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and their numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word.

    ``bounds`` holds where the parts begin and ``near`` the rank of each part
    joined with the next one. The smallest rank is sought by a scan, its
    boundary deleted, and the two ranks beside it are looked up again.
    """
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    none, get = len(ranks) + 1, ranks.get
    bounds = list(range(len(word) + 1))
    near = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near and (least := min(near)) < none:
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
    return tuple(ranks[word[a:b]] for a, b in zip(bounds, bounds[1:]))


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same ids in n log n steps, for words that no scan should go over again and again."""
    n, get = len(word), ranks.get
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if not (alive[i] and after[i] == mid and mid < n and alive[mid] and after[mid] == end):
            continue
        alive[mid] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, end, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(out)


class Encoder(dict):
    """word -> ids; encodes a word when first asked for it. ``ids(text)`` encodes a text."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.words, self.simple = ranks, regex.compile(PATTERN).findall, re.compile(_SIMPLE, re.ASCII).findall
        self.odd = re.compile(rf"[^\t-\r -~{_LETTERS}{_SIGNS}]").search

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = encode_word(word.encode("utf-8", "replace"), self.ranks)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, self.cut(text)))

    def cut(self, text: str) -> list[str]:
        return self.words(text) if self.odd(text) else self.simple(text)


_known: dict[str, Encoder] = {}


def _encoder(name: str, ranks: Broadcast) -> Encoder:
    """The worker's encoder; a Python worker serves several tasks, so words stay known between them."""
    if name not in _known:
        _known[name] = Encoder(ranks.value)
    return _known[name]


def shared_ranks(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Broadcast:
    """The vocabulary for the executors: a fixed 50 thousand entries, whatever the corpus."""
    return spark.sparkContext.broadcast(read_ranks(f"{folder}/{name}.tiktoken"))


def encode_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id bigint, ids array<int>): each row's text as ids, without special tokens; no shuffle.

    An empty or null text has the empty list. Strings that look like special
    tokens are ordinary text. Repeated rows and null doc_ids are kept; other
    columns are not read.
    """
    ranks = shared_ranks(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(f"{folder}/{vocabulary}", ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts = [np.fromiter(enc.ids(t), dtype=np.int32) if t else _NONE for t in batch.column(1).to_pylist()]
                ends = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum([len(p) for p in parts], out=ends[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


_NONE = np.empty(0, dtype=np.int32)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The columns ``keep`` and n_tokens bigint, the number of ids of each row's text; 0 for an empty or null text."""
    ranks = shared_ranks(df.sparkSession, vocabulary, folder)
    picked = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(f"{folder}/{vocabulary}", ranks)
        for batch in batches:
            sizes = []
            for t in batch.column(len(keep)).to_pylist():
                words = enc.cut(t) if t else ()
                sizes.append(sum(map(len, map(enc.__getitem__, words))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long")
