"""Matching the works of two tables that share no identifier, by sorted neighbourhoods."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions.packed import first_value, plain
from refloom.llm.assignment import one_to_one
from refloom.llm.edit_metric import distance, to_roots
from refloom.llm.format_dups import bare
from refloom.llm.name_variants import ORG_WORDS, parse
from refloom.session import staged

#: Distinct keys of the other table that each key is compared with, to each side of it in every order.
WINDOW = 10
#: Least confidence of a match, and how far a match may lie below the best of either side.
LEAST, MARGIN = 0.78, 0.15

# Words of a title that is about another work, and shortened words.
_ABOUT = re.compile(r"^(erratum|errata|corrigendum|correction|addendum|retraction|review|comment|comments|reply|response)\s+(?:to|of|on)?\s*")
_SHORT = {"thm": "theorem", "thms": "theorems", "conj": "conjecture", "mfld": "manifold", "mflds": "manifolds", "ineq": "inequality", "prop": "proposition", "alg": "algebra", "algs": "algebras", "geom": "geometry", "eqn": "equation", "fns": "functions", "fn": "function"}
_PARTS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, **{str(n): n for n in range(1, 21)}}


# Words that carry no subject.
_LIGHT = set("a an the on of for and in with as at by from to about some how is are its their via under near among over new note notes remarks remark".split())


_WORD = re.compile(r"[a-z0-9]+")
_ODD = re.compile(r"[<&\\{}]")
_LEAD = re.compile(r"\s*(erratum|corrigendum|correction|addendum|review|comment|reply)\b[^:“\"]*[:“\"]\s*", re.I)


_SUB = re.compile(r":\s|\s[-–—]+\s")
_LEADS = set("erratum errata corrigendum correction addendum retraction review comment comments reply response".split())


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return [_SHORT.get(w, w) for w in _WORD.findall(text.lower())]


def title_parts(title: str | None) -> tuple[str, str, int, str]:
    """(words before the subtitle, all words, part of a series or 0, what the text is about another work or '')."""
    text = plain(title or "")
    if _ODD.search(text):
        text = plain(re.sub(r"<[^>]+>", " ", html.unescape(text)))
        text = re.sub(r"\\[\"'`^~=.]\s*\{?(\w)\}?", r"\1", text)
        text = re.sub(r"\\[A-Za-z]+\s*", " ", text).replace("{", "").replace("}", "")
    lead = _LEAD.match(text)
    kind = lead.group(1).lower() if lead else ""
    if lead:
        text = text[lead.end() :]
    cut = _SUB.search(text)
    main = _words(text[: cut.start()] if cut else text)
    full = main + _words(text[cut.end() :]) if cut else main.copy()
    if not kind and len(full) > 3 and full[0] in _LEADS and (m := _ABOUT.match(" ".join(full))):
        kind = m.group(1)
        main, full = main[m.group(0).count(" ") :], full[m.group(0).count(" ") :]
    part = 0
    for words in (full, main):
        if words and words[-1] in _PARTS and len(words) > 2 and (words[-2] == "part" or words[-1].isalpha() and words[-1] != "x"):
            part = _PARTS[words.pop()]
            if words[-1] == "part":
                words.pop()
    for words in (full, main):
        if len(words) > 2 and words[0] in ("the", "a", "an"):
            del words[0]
    return " ".join(main), " ".join(full), part, kind


def first_names(author: str | None, single: bool = False) -> list[str]:
    """Words that may be the family name of the first author, or the whole name of an organisation, the likeliest first. ``single``: the text is one name."""
    if not author or not author.strip() or not (found := author if single else first_value(author)):
        return []
    org, family, given, _, sure = parse(found)
    names = [family] if org or sure or len(given) < 2 else [family, given]
    return [n.replace("ph", "f") for n in names if n]


_SEEN = [("main", pa.string()), ("full", pa.string()), ("part", pa.int32()), ("kind", pa.string()), ("names", pa.list_(pa.string()))]


def _see(batches: Iterator[pa.RecordBatch], single: bool = False) -> Iterator[pa.RecordBatch]:
    """Title and author, the first two columns, replaced by what is compared of them; the other columns pass through."""
    titles: dict[str, tuple] = {}
    authors: dict[str, list[str]] = {}
    for batch in batches:
        if len(titles) + len(authors) > 200_000:
            titles, authors = {}, {}
        rows = []
        for title, author in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if title not in titles:
                titles[title] = title_parts(title)
            if author not in authors:
                authors[author] = first_names(author, single)
            rows.append((*titles[title], authors[author] or None))
        made = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_SEEN)]
        yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], [*(n for n, _ in _SEEN), *batch.schema.names[2:]])


def _seen_schema(rows: DataFrame) -> str:
    return "main string, full string, part int, kind string, names array<string>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])


def _see_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _see(batches, True)


def year_of(text: Column) -> Column:
    """The year a text begins with, null outside 1600 to 2030."""
    y = F.substring(F.trim(text), 1, 4).try_cast("int")
    return F.when(F.trim(text).rlike(r"^\d{4}") & y.between(1600, 2030), y)


def cited_units(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations gathered to units that are one work for certain, and (ref_id, unit).

    Rows with the same DOI or arXiv id in normalized_id are one unit (an arXiv id
    that stands beside a DOI anywhere counts as that DOI); the others are one if
    title, author, year, volume and pages agree. A unit has the most frequent of
    each attribute; the counts are combined before they are shuffled.
    """
    doi = F.nullif(bare(F.regexp_extract(F.lower("normalized_id"), r"\bdoi\s*:\s*([^\s,;|]+)", 1)), F.lit(""))
    arxiv = F.nullif(bare(F.regexp_extract(F.lower("normalized_id"), r"\barxiv\s*:\s*([^\s,;|]+)", 1)), F.lit(""))
    rows = citations.select("title", "author", F.col("ref_id").cast("long").alias("id"), year_of(F.col("year")).alias("year"), F.nullif(F.trim("volume"), F.lit("")).alias("volume"), F.nullif(F.regexp_replace("pages", r"[^0-9A-Za-z]+", "-"), F.lit("")).alias("pages"), doi.alias("doi"), arxiv.alias("arxiv"))
    # a row without a title is no citation here, but its DOI may stand beside an arXiv id
    blank = F.coalesce(F.trim("title") == "", F.lit(True))
    rows = rows.where(~blank | (F.col("doi").isNotNull() & F.col("arxiv").isNotNull())).withColumns({"author": F.when(~blank, F.col("author")), "title": F.when(~blank, F.col("title"))})
    seen = rows.mapInArrow(_see, _seen_schema(rows))
    loose = F.concat(F.lit("t:"), F.md5(F.concat_ws("\u0001", "full", F.col("part").cast("string"), "kind", F.coalesce(F.get("names", F.lit(0)), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("volume", F.lit("")), F.coalesce("pages", F.lit("")))))
    code = F.when(F.col("doi").isNotNull(), F.concat(F.lit("d:"), F.col("doi"))).when(F.col("arxiv").isNull(), loose)
    both = F.col("doi").isNotNull() & F.col("arxiv").isNotNull()
    alone = F.col("doi").isNull() & F.col("arxiv").isNotNull()
    cited = staged(seen.where((F.col("full") != "") | both).select("id", code.alias("unit"), F.when(both, F.col("doi")).alias("beside"), F.when(both | alone, F.col("arxiv")).alias("arxiv"), F.struct("main", "full", "part", "kind").alias("title"), "names", "year", "volume", "pages"), "cited")
    known = cited.where("beside is not null").groupBy("arxiv").agg(F.min("beside").alias("beside"))
    rows = cited.where("title.full <> ''").drop("beside")
    # only rows with an arXiv id alone look for the DOI beside it
    alone = rows.where("unit is null").join(known, "arxiv", "left").withColumn("unit", F.coalesce(F.concat(F.lit("d:"), F.col("beside")), F.concat(F.lit("a:"), F.col("arxiv")))).drop("beside")
    rows = rows.where("unit is not null").unionByName(alone).drop("arxiv")
    units = rows.groupBy("unit").agg(*(F.mode(c, True).alias(c) for c in ("title", "names", "year", "volume", "pages")))
    return units.select("unit", "title.*", "names", "year", "volume", "pages"), rows.select("id", "unit")


def registry_units(registry: DataFrame) -> DataFrame:
    """Registry records with the attributes that are compared; records without a title are left out."""
    rows = registry.where(F.col("title").isNotNull()).select("title", F.col("first_author").alias("author"), F.col("reg_id").cast("long").alias("reg_id"), F.coalesce("years", F.array().cast("array<int>")).alias("years"), F.nullif(F.trim("volume"), F.lit("")).alias("volume"), F.nullif(F.regexp_replace("page", r"[^0-9A-Za-z]+", "-"), F.lit("")).alias("pages"), (F.lower("type") == "review").alias("review"))
    seen = rows.mapInArrow(_see_single, _seen_schema(rows)).where("full <> ''")
    kind = F.when(F.col("review") & (F.col("kind") == ""), "review").otherwise(F.col("kind"))
    return seen.select("reg_id", "main", "full", "part", kind.alias("kind"), "names", "years", "volume", "pages")


def sort_keys(years: Column) -> Column:
    """The composite keys: title from its start, title from its end, first author with year, first author with title, volume with pages."""
    name = F.coalesce(F.get("names", F.lit(0)), F.lit(""))
    turned = F.array_join(F.reverse(F.split("main", " ")), " ")
    keys = [F.array(F.concat(F.lit("1|"), F.col("main")), F.concat(F.lit("2|"), turned))]
    named = F.flatten(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.array(F.concat(F.lit("4|"), n, F.lit(" "), F.lit("|"), F.col("main"))), F.transform(years, lambda y: F.concat(F.lit("3|"), n, F.lit(" "), y.cast("string"), F.lit("|"), F.col("main"))))))
    paged = F.when(F.col("pages").isNotNull() & F.col("volume").isNotNull(), F.array(F.concat(F.lit("5|"), "pages", F.lit(" "), "volume", F.lit(" "), name, F.lit("|"), F.col("main"))))
    return F.concat(*keys, named, F.coalesce(paged, F.array().cast("array<string>")))


def _subject(key: str) -> frozenset[str]:
    """The beginnings of the words of subject in a key's title."""
    return frozenset(w[:3] for w in key[key.rindex("|") + 1 :].split(" ") if w not in _LIGHT)


def _alike(x: frozenset[str], y: frozenset[str]) -> bool:
    """Whether two titles share half of the shorter one's words of subject."""
    least = min(len(x), len(y))
    return least < 2 or 2 * len(x & y) >= least  # a single word may be misspelt where it begins


#: What a row brings to its keys: its number, the first and last year that go with it, and hashes of part with kind, volume and pages, -1 where it has none.
_MARKS = ["lo", "hi", "part", "volume", "pages"]


def _marks(first: Column, last: Column) -> list[Column]:
    mark = lambda *c: F.hash(*c).bitwiseAND(2**31 - 1)  # noqa: E731 - other hashes, other values
    one = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), mark(c)), F.lit(-1))
    exprs = [F.coalesce(first, F.lit(-(2**31))), F.coalesce(last, F.lit(2**31 - 1)), mark("part", "kind"), one("volume"), one("pages")]
    return [x.cast("int").alias(f"m_{c}") for c, x in zip(_MARKS, exprs)]


def _product(r: np.ndarray, nr: np.ndarray, u: np.ndarray, nu: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows r ... r + nr - 1 with u ... u + nu - 1, about a million at a time."""
    at, sizes = 0, nr * nu
    ends = np.cumsum(sizes)
    while at < len(r):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        if to == at + 1 and sizes[at] > 1_000_000:  # one key of very many rows: row by row
            for i in range(int(r[at]), int(r[at] + nr[at])):
                us = np.arange(u[at], u[at] + nu[at])
                yield np.full(len(us), i), us
        else:
            n = sizes[at:to]
            which = np.repeat(np.arange(at, to), n)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield r[which] + inner // nu[which], u[which] + inner % nu[which]
        at = to


def _starts(k: pa.Array, side: np.ndarray) -> np.ndarray:
    """Where the runs of equal key and side begin."""
    if not len(k):
        return np.zeros(0, dtype=np.int64)
    new = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False) | (side[1:] != side[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _slide(rows: pa.RecordBatch, old: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (registry row, unit row), by their numbers, of ``rows`` (k, side, id, marks) in order whose keys have fewer than WINDOW distinct unit keys of the same order between them.

    Only pairs of the first ``old`` rows with the others, and with ``inside``
    those among the others. Pairs whose marks differ or whose titles are not
    alike are left out.
    """
    k, side, code = rows.column(0), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    lo, hi, part, volume, pages = (rows.column(i).to_numpy() for i in range(3, 8))
    start = _starts(k, side)
    end = np.append(start[1:], len(k))[: len(start)]
    keys = k.take(pa.array(start)).to_pylist()
    order = np.array([ord(x[0]) for x in keys], dtype=np.int32)
    units, regs = np.flatnonzero(side[start] == 0), np.flatnonzero(side[start] == 1)
    before = np.searchsorted(units, regs)
    near = []
    for step in range(-WINDOW, WINDOW):
        at = before + step
        ok = (at >= 0) & (at < len(units))
        r, u = regs[ok], units[at[ok]]
        near.append((r, u))
    r, u = (np.concatenate(x) for x in zip(*near))
    ok = (order[r] == order[u]) & ((end[r] > old) | (end[u] > old))
    r, u = r[ok], u[ok]
    first = np.maximum(start, old)  # the new rows of each key
    parts = [(start[r], np.minimum(end[r], old), first[u], end[u]), (first[r], end[r], start[u], end[u] if inside else np.minimum(end[u], old))]
    found: list[tuple[np.ndarray, ...]] = []
    for r0, r1, u0, u1 in parts:
        some = np.flatnonzero((r1 > r0) & (u1 > u0))
        for x, y in _product(r0[some], (r1 - r0)[some], u0[some], (u1 - u0)[some]):
            ok = (lo[x] <= hi[y]) & (lo[y] <= hi[x]) & (part[x] == part[y])
            for m in (volume, pages):
                ok &= (m[x] == m[y]) | (m[x] < 0) | (m[y] < 0)
            found.append((x[ok], y[ok]))
    if not found:
        return code[:0], code[:0]
    x, y = (np.concatenate(f) for f in zip(*found))
    # titles are compared once for each two keys
    kx, ky = np.searchsorted(start, x, "right") - 1, np.searchsorted(start, y, "right") - 1
    both, which = np.unique(kx * len(keys) + ky, return_inverse=True)
    a, b = (both // len(keys)).tolist(), (both % len(keys)).tolist()
    words = {i: _subject(keys[i]) for i in {*a, *b}}
    ok = np.fromiter((_alike(words[i], words[j]) for i, j in zip(a, b)), dtype=bool, count=len(a))[which]
    return code[x[ok]], code[y[ok]]


_KEYS = ["k", "side", "id", *(f"m_{c}" for c in _MARKS)]
_SLID = "a long, b long, edge long, block long, k string, side int, id long, " + ", ".join(f"m_{c} int" for c in _MARKS)
_KINDS = [pa.string(), pa.int32(), pa.int64(), *[pa.int32()] * len(_MARKS)]


def _slid(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.array(np.full(len(a), -1), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, *(pa.nulls(len(a), t) for t in _KINDS)], ["a", "b", "edge", "block", *_KEYS])


def _handed(rows: pa.RecordBatch, edge: int, block: int) -> pa.RecordBatch:
    """The rows that a range hands to a neighbour."""
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(2)), *(pa.array(np.full(n, x), pa.int64()) for x in (edge, block)), *rows.columns], ["a", "b", "edge", "block", *_KEYS])


def window_pairs(keys: DataFrame, size: int) -> DataFrame:
    """(reg_id, number): rows with keys near each other in their order, compared cheaply.

    ``keys`` has ``_KEYS``, a row for each key of each unit (side 0) and record (side 1), and about ``size`` rows.
    The order is cut into ranges; a range hands the rows within a window of its ends to its neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        tail: pa.RecordBatch | None = None
        met, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if met <= WINDOW:  # the head ends before the unit key that follows the WINDOW-th
                side = batch.column(1).to_numpy()
                start = _starts(batch.column(0), side)
                start = start[side[start] == 0]
                names = batch.column(0).take(pa.array(start)).to_pylist()
                start = start[1:] if names and names[0] == last else start
                last = names[-1] if names else last
                full = met + len(start) > WINDOW
                yield _handed(batch.slice(0, int(start[WINDOW - met])) if full else batch, at, 1)
                met += len(start)
            old = tail.num_rows if tail is not None else 0
            rows = pa.concat_batches([tail, batch]) if old else batch
            yield _slid(*_slide(rows, old, True))
            side = rows.column(1).to_numpy()
            start = _starts(rows.column(0), side)
            units = np.flatnonzero(side[start] == 0)  # the tail begins behind the last unit key that no later row can reach
            cut = int(units[-WINDOW - 1]) + 1 if len(units) > WINDOW else 0
            tail = rows.slice(int(start[cut]) if cut else 0)
        if tail is not None:
            yield _handed(tail, at + 1, 0)

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("block", "k", "side")])
        old = pc.sum(pc.equal(table["block"], 0)).as_py() or 0
        rows = pa.RecordBatch.from_arrays([table[c].combine_chunks() for c in _KEYS], _KEYS)
        r, u = _slide(rows, old, False)
        return pa.table({"a": pa.array(r, pa.int64()), "b": pa.array(u, pa.int64())})

    n = max(2, keys.sparkSession.sparkContext.defaultParallelism, size // 200_000)
    out = staged(keys.select(*_KEYS).repartitionByRange(n, "k", "side").sortWithinPartitions("k", "side").mapInArrow(run, _SLID), "slid")
    inside = out.where("edge < 0").select("a", "b")
    edges = out.where("edge >= 0").groupBy("edge").applyInArrow(across, "a long, b long")
    return inside.unionByName(edges).select(F.col("a").alias("reg_id"), F.col("b").alias("number"))


@F.arrow_udf(T.DoubleType())
def _name_likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(xs: list[str] | None, ys: list[str] | None) -> float:
        if xs is None or ys is None:
            return 0.0
        best = 0.0
        for x in xs:
            for y in ys:
                if x == y:
                    return 1.0
                size = max(len(x), len(y))
                if " " in x or " " in y:
                    x2, y2 = (" ".join(ORG_WORDS.get(w, w) for w in n.split()) for n in (x, y))
                    best = max(best, 1 - distance(x2, y2) / max(len(x2), len(y2)))
                elif abs(len(x) - len(y)) <= 2 and size >= 4 and len(set(x) ^ set(y)) <= 4:
                    d = distance(x, y)
                    best = max(best, 0.95 if d == 1 else 0.7 if d == 2 and size >= 7 else 0.0)
                elif min(len(x), len(y)) == 1 and x[0] == y[0] and len(xs) + len(ys) > 2:
                    best = max(best, 0.2)
        return best

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@lru_cache(maxsize=200_000)
def _one_word(a: str, b: str) -> bool:
    """Whether two words are one: equal, misspelt, or one shortened."""
    if a == b:
        return True
    short, long = (b, a) if len(b) < len(a) else (a, b)
    if short[0] == long[0] and len(short) >= 3 and len(long) >= len(short) + 3:  # perms, proj, cpctness
        rest = iter(long)
        return all(c in rest for c in (short[:-1] if short[-1] == "s" else short))
    if len(long) - len(short) > 2 or len(long) < 4:
        return False
    most = 1 if len(long) < 7 else 2
    # an edit changes the sets of letters by two at most
    return len(set(a) ^ set(b)) <= 2 * most and distance(a, b) <= most


def title_likeness(a: str, b: str) -> float:
    """2 * shared words / all words, misspelt and shortened words counting as shared.

    A word left out costs little; words of subject that stand against each
    other on both sides make it another title: each such pair takes 0.3 off. A
    title of six words or more, of which most are not in the other as they are,
    is not compared further.
    """
    if a == b:
        return 1.0
    x, y = a.split(" "), b.split(" ")
    free, lone = list(y), []
    for w in x:
        if w in free:
            free.remove(w)
        else:
            lone.append(w)
    left = []
    if len(x) > 5 and 2 * len(lone) > len(x) + 2:
        return 0.0
    for w in lone:
        twin = None if w in _LIGHT else next((v for v in free if v not in _LIGHT and _one_word(w, v)), None)
        if twin is None:
            left.append(w)
        else:
            free.remove(twin)
    against = min(sum(w not in _LIGHT for w in left), sum(w not in _LIGHT for w in free))
    light = sum(w in _LIGHT for w in left) + sum(w in _LIGHT for w in free)
    size = len(x) + len(y)
    return max(0.0, (size - len(left) - len(free) + 0.5 * light) / size - 0.3 * against)


@F.arrow_udf(T.DoubleType())
def _titles(um: pa.Array, uf: pa.Array, rm: pa.Array, rf: pa.Array) -> pa.Array:
    """Of whole titles, or of one without its subtitle with the other that has none."""

    def one(a: str, b: str, c: str, d: str) -> float:
        whole = title_likeness(b, d)
        if whole == 1 or (a != b) == (c != d):  # both or neither have a subtitle
            return whole
        return max(whole, 0.98 * title_likeness(a, c))

    return pa.array([one(*x) for x in zip(um.to_pylist(), uf.to_pylist(), rm.to_pylist(), rf.to_pylist())], pa.float64())


def without_conflict(pairs: DataFrame) -> DataFrame:
    """``pairs`` with year, pages and volume likeness (y, p, v; null where a side lacks it), without those that cannot be one work.

    That is: another part of a series, a text about the work, years more than two
    apart, other pages or another volume.
    """
    off = F.array_min(F.transform("r_years", lambda y: F.abs(y - F.col("u_year"))))
    agree = lambda c: F.when(F.col(f"u_{c}").isNotNull() & F.col(f"r_{c}").isNotNull(), (F.col(f"u_{c}") == F.col(f"r_{c}")).cast("double"))
    year = F.when(off == 0, 1.0).when(off == 1, 0.85).when(off == 2, 0.5).when(off > 2, 0.0)
    same = pairs.where((F.col("u_part") == F.col("r_part")) & (F.col("u_kind") == F.col("r_kind")))
    return same.withColumns({"y": year, "p": agree("pages"), "v": agree("volume")}).where("coalesce(y, 1) > 0 and coalesce(p, 1) > 0 and coalesce(v, 1) > 0")


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` with title and name likeness (t, a) and confidence.

    The confidence is the mean of the likenesses that both sides allow, by the
    weights title 0.5, name 0.25, year 0.15, pages 0.2, volume 0.1. Pairs whose
    first authors are others, or whose titles differ in half or more, are left out.
    """
    out = pairs.withColumn("t", _titles("u_main", "u_full", "r_main", "r_full")).where("t >= 0.5")
    name = F.when(F.col("u_names").isNotNull() & F.col("r_names").isNotNull(), _name_likeness("u_names", "r_names"))
    out = out.withColumn("a", name).where("coalesce(a, 1) >= 0.5")
    parts = [("t", 0.5), ("a", 0.25), ("y", 0.15), ("p", 0.2), ("v", 0.1)]
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return out.withColumn("confidence", F.round(total / weight, 4))


def record_works(good: DataFrame, regs: DataFrame) -> DataFrame:
    """(reg_id, work): records of one work, which match a common unit and each other, under the smallest reg_id among them; others are works of their own.

    A unit has no more records than the windows of its keys hold, so its records
    are compared in pairs.
    """
    ids = good.select("unit", "reg_id")
    both = ids.withColumnRenamed("reg_id", "low").join(ids, "unit").where("low < reg_id").select("low", "reg_id").distinct()
    attributes = ("main", "full", "names", "part", "kind", "volume", "pages", "years")
    side = lambda x, key: regs.select(F.col("reg_id").alias(key), *(F.col(c).alias(f"{x}_{c}") for c in attributes))
    pairs = both.join(side("u", "low"), "low").join(side("r", "reg_id"), "reg_id")
    # of two lists of years the nearest ones count
    nearest = F.array_min(F.flatten(F.transform("u_years", lambda x: F.transform("r_years", lambda y: F.struct(F.abs(x - y).alias("off"), x.alias("year"))))))["year"]
    same = scored(without_conflict(pairs.withColumn("u_year", nearest))).where(F.col("confidence") >= LEAST)
    links = to_roots(same.groupBy("reg_id").agg(F.min("low").alias("work")), "reg_id", "work")
    return regs.select("reg_id").join(links, "reg_id", "left").select("reg_id", F.coalesce("work", "reg_id").alias("work"))


def match_units(citations: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((unit, reg_id, confidence, ...), (id, unit)): the matches between works as cited and registry records."""
    units, rows = cited_units(citations)
    # pairs are two numbers; a unit's number may stand for two units, which are then both compared
    number = F.xxhash64("unit").alias("number")
    units, regs = staged(units.withColumn("number", number), "units"), staged(registry_units(registry), "regs")
    # years up to two apart may be those of one work
    ukeys = units.select(F.col("number").alias("id"), *_marks(F.col("year") - 2, F.col("year") + 2), F.explode(sort_keys(F.when(F.col("year").isNotNull(), F.array("year")).otherwise(F.array().cast("array<int>")))).alias("k"), F.lit(0).alias("side"))
    rkeys = regs.select(F.col("reg_id").alias("id"), *_marks(F.array_min("years"), F.array_max("years")), F.explode(sort_keys(F.col("years"))).alias("k"), F.lit(1).alias("side"))
    # the marks come with the keys and rule most pairs out before titles and names are joined
    pairs = window_pairs(ukeys.unionByName(rkeys), 5 * (units.count() + regs.count())).distinct()
    attributes = ("main", "full", "names", "part", "kind", "volume", "pages")
    pairs = pairs.join(regs.select("reg_id", *(F.col(c).alias(f"r_{c}") for c in (*attributes, "years"))), "reg_id").join(units.select("unit", "number", *(F.col(c).alias(f"u_{c}") for c in (*attributes, "year"))), "number")
    good = staged(scored(without_conflict(pairs)).where(F.col("confidence") >= LEAST).select("unit", "reg_id", "confidence"), "scored")
    return assigned(good, regs), rows


def assigned(good: DataFrame, regs: DataFrame) -> DataFrame:
    """The matches of ``good`` (unit, reg_id, confidence) that an assignment of works keeps.

    Records are gathered to works first. Units with a DOI are works for certain:
    they and the registry's works are assigned one to one. Units without are
    citations of some work that is not named by an identifier, so many may go
    to one work; they go to what lies within ``MARGIN`` of their best.
    """
    works = staged(record_works(good, regs), "works")
    good = staged(good.join(works, "reg_id").select("unit", "reg_id", "work", "confidence"), "worked")
    certain = F.col("unit").startswith("d:")
    pairs = good.where(certain).groupBy("unit", "work").agg(F.max("confidence").alias("c"))
    chosen = one_to_one(pairs.select(F.col("unit").alias("left"), F.col("work").alias("right"), "c"))
    sure = good.where(certain).join(chosen.select(F.col("left").alias("unit"), F.col("right").alias("work")), ["unit", "work"])
    candidates = sure.unionByName(good.where(~certain))
    best_u = candidates.groupBy("unit").agg(F.max("confidence").alias("best_u"))
    best_r = candidates.groupBy("reg_id").agg(F.max("confidence").alias("best_r"))
    return candidates.join(best_u, "unit").join(best_r, "reg_id").where(F.col("confidence") >= F.greatest("best_u", "best_r") - MARGIN)


def matches(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """(ref_id, reg_id, confidence): citations with a title and registry records of the same work.

    Citations are gathered to units and records to works, which are assigned to
    each other (:func:`assigned`); no match is below ``LEAST``. Equal keys of any
    order always meet, others within ``WINDOW`` keys. A citation without a title and a record without one
    match nothing; missing authors, years, volumes and pages are left out of the
    comparison. Repeated rows each match. Other columns are ignored.
    """
    kept, rows = match_units(citations, registry)
    return rows.join(kept.select("unit", "reg_id", "confidence"), "unit").select(F.col("id").alias("ref_id"), "reg_id", "confidence")
