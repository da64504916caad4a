"""The Damerau-Levenshtein metric, and exact radius joins under it in metric-space cells."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.session import staged

#: Keys for which a further pivot pays, the bounded sample from which pivots are chosen at the driver, and the most pivots: no key lies in more cells than these.
PER_PIVOT, PIVOT_SAMPLE, MOST_PIVOTS = 4000, 2048, 8


#: The odd base of the hashes of deletion forms, and what tells those of one cell from those of the next.
_BASE, _BY_CELL = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and transpositions of neighbours, without restriction, so the triangle inequality holds."""
    if a == b:
        return 0
    # what both begin or end with costs nothing, and whatever is left has one character
    n, m = len(a), len(b)
    least = min(n, m)
    i = j = 0
    while i < least and a[i] == b[i]:
        i += 1
    while j < least - i and a[-1 - j] == b[-1 - j]:
        j += 1
    if i or j:
        a, b, n, m = a[i : n - j], b[i : m - j], n - i - j, m - i - j
    if not n or not m or n == m == 1:
        return max(n, m)
    far, seen = n + m, {}
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        last, x, row, up = 0, a[i - 1], d[i + 1], d[i]
        for j in range(1, m + 1):
            k, el = seen.get(b[j - 1], 0), last
            cost = 1
            if x == b[j - 1]:
                cost, last = 0, j
            row[j + 1] = min(up[j] + cost, row[j] + 1, up[j + 1] + 1, d[k][el] + (i - k - 1) + 1 + (j - el - 1))
        seen[x] = i
    return d[n + 1][m + 1]


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of each key, 0 behind its end, and its length."""
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    codes = np.zeros((len(keys), int(sizes.max(initial=0))), dtype=np.uint32)
    flat = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
    return codes, sizes


def distances(keys: list[str], pivot: str) -> np.ndarray:
    """:func:`distance` of every key to one pivot, computed over all keys at once."""
    n, m = len(keys), len(pivot)
    codes, sizes = _codes(keys)
    width = codes.shape[1]
    wanted = [ord(c) for c in pivot]
    rows = np.arange(n)
    far = width + m
    d = np.full((width + 2, m + 2, n), far, dtype=np.int16)
    d[1:, 1] = np.arange(width + 1)[:, None]
    d[1, 1:] = np.arange(m + 1)[:, None]
    seen = {c: np.zeros(n, dtype=np.int64) for c in wanted}
    for i in range(1, width + 1):
        x, last = codes[:, i - 1], np.zeros(n, dtype=np.int64)
        for j in range(1, m + 1):
            c = wanted[j - 1]
            k, same = seen[c], x == c
            swap = d[k, last, rows] + (i - k - 1) + 1 + (j - last - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), swap)
            last = np.where(same, j, last)
        for c in seen:
            seen[c] = np.where(x == c, i, seen[c])
    return d[sizes + 1, m + 1, rows].astype(np.int64)


def choose_pivots(sample: list[str], most: int) -> list[str]:
    """Pivots far from each other: each next one is the key farthest from those before it."""
    sample = sorted(set(sample))
    if not sample:
        return []
    pivots = [sample[len(sample) // 2]]
    near = distances(sample, pivots[0])
    while len(pivots) < most and near.max() > 2:
        pivots.append(sample[int(near.argmax())])
        near = np.minimum(near, distances(sample, pivots[-1]))
    return pivots


def deletion_forms(keys: list[str], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the key, hash): the keys with up to ``radius`` characters left out. Keys within the radius of each other share one of these.

    The hash is a polynomial in an odd base, so that of a key without some
    characters follows from the sums up to them. A letter that stands twice in a
    row is left out once.
    """
    codes, sizes = _codes(keys)
    n, width = codes.shape
    base, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    sums = np.zeros((n, width + 1), dtype=np.uint64)
    power = np.ones(1, dtype=np.uint64)
    for i in range(width):
        sums[:, i + 1] = sums[:, i] + codes[:, i] * power
        power = power * base
    who, hashes = [], []
    for left_out in (c for r in range(radius + 1) for c in combinations(range(width), r)):
        own = np.ones(n, dtype=bool)
        for i in left_out:
            own &= sizes > i
            if i and i - 1 not in left_out:
                own &= codes[:, i] != codes[:, i - 1]
        rows = np.flatnonzero(own)
        total, begin, shift = np.zeros(len(rows), dtype=np.uint64), 0, np.ones(1, dtype=np.uint64)
        for i in (*left_out, width):
            total += (sums[rows, i] - sums[rows, begin]) * shift
            begin, shift = i + 1, shift * back
        who.append(rows)
        hashes.append(total)
    return np.concatenate(who), np.concatenate(hashes)


def radius_join(keys: DataFrame, key: str, radius: int = 1) -> DataFrame:
    """(a, b): every two distinct keys, a < b, within ``radius`` of each other under :func:`distance`.

    Each key belongs to the cell of its nearest pivot, the first of equally near
    ones. Of two keys with other cells, i < j, the one of cell i is replicated to
    cell j, so a pair meets in one cell only. Whatever is within r of a key of
    cell j, which is nearer to pivot j than to pivot i, is by the triangle
    inequality at most 2 * r - 1 farther from pivot j than from pivot i; farther
    keys are not replicated. Distances between short names are much
    alike, so more pivots mean more replicas; there are at most ``MOST_PIVOTS``,
    whatever the number of keys. A cell is no unit of work: inside it, keys that
    share a deletion form, of which there are no more than letters times places
    to insert them, are brought together by a shuffle and a sort, and these
    candidates are compared with the metric itself. Nothing is capped.
    Nulls are left out, repeated keys count once, the empty key is a key.
    """
    distinct = staged(keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct(), "keys")
    n = distinct.count()
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("key")).limit(PIVOT_SAMPLE).collect()] if n > PER_PIVOT else []
    pivots = choose_pivots(sample, max(1, min(MOST_PIVOTS, -(-n // PER_PIVOT))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096)
                texts = own.to_pylist()
                d = np.stack([distances(texts, p) for p in pivots]) if len(pivots) > 1 else np.zeros((1, len(texts)), dtype=np.int64)
                home = d.argmin(axis=0)
                later = np.arange(len(d))[:, None] > home
                here = (later & (d - d.min(axis=0) <= 2 * radius - 1)) | (np.arange(len(d))[:, None] == home)
                cell, who = np.nonzero(here)
                of, form = deletion_forms(texts, radius)
                by_key = np.argsort(of, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(form[by_key].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), own.take(pa.array(who)), pa.array(home[who] == cell), lists.take(pa.array(who))], ["cell", "key", "home", "forms"])

    cells = distinct.mapInArrow(assign, "cell int, key string, home boolean, forms array<long>")
    if len(pivots) > 1:
        cells = staged(cells, "cells")
    # keys meet within a cell, so its number goes into the form
    forms = cells.select(F.explode("forms").alias("form"), "cell", "key", "home").select(F.col("form").bitwiseXOR(F.col("cell") * F.lit(_BY_CELL)).alias("form"), "key", "home")
    return forms.repartition("form").sortWithinPartitions("form").mapInArrow(_near(radius), "a string, b string").distinct()


def _near(radius: int):
    """Batches of (form, key, home), in the order of the forms: the pairs of keys of one form, one of them at home, that are within the radius."""

    def pairs(form: np.ndarray, keys: pa.Array, home: np.ndarray) -> pa.RecordBatch:
        found = set()
        starts = np.flatnonzero(np.r_[True, form[1:] != form[:-1]]) if len(form) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(form)])
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            names, homes = keys.slice(start, size).to_pylist(), home[start : start + size].tolist()
            for i, x in enumerate(names):
                for y, at_home in zip(names[:i], homes):
                    if (at_home or homes[i]) and x != y and abs(len(x) - len(y)) <= radius:
                        pair = (x, y) if x < y else (y, x)
                        if pair not in found and distance(x, y) <= radius:
                            found.add(pair)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            form = batch.column(0).to_numpy()
            # the last form may go on in the next batch
            cut = int(np.searchsorted(form, form[-1]))
            if cut or (kept and kept[-1].column(0)[-1].as_py() != form[-1]):
                table = pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
                yield pairs(*_columns(table))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield pairs(*_columns(pa.Table.from_batches(kept).combine_chunks()))

    return run


def _columns(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    form, keys, home = (c.combine_chunks() for c in table.columns)
    return form.to_numpy(), keys, home.to_numpy(zero_copy_only=False)


def to_roots(links: DataFrame, at: str, to: str) -> DataFrame:
    """``links`` (at -> to, one for each ``at``, without circles) followed to their ends.

    Each round doubles the way that is known, until no end is the beginning of a
    link any more: as many rounds as the longest chain has binary digits.
    """
    links = staged(links.select(at, to), "links")
    while True:
        further = links.select(F.col(at).alias(to), F.col(to).alias("__end"))
        if links.join(further, to, "left_semi").isEmpty():
            return links
        links = staged(links.join(further, to, "left").select(at, F.coalesce("__end", to).alias(to)), "links")
