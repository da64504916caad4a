"""One consistent form of text that looks the same in different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions.lookalikes import LOOKALIKES
from refloom.llm.class_pairs import class_join
from refloom.session import skew_join, staged

# Non-ASCII runs are the only text that can be unstable; the character before one is its boundary context, as a mark composes with it.
_SEGMENT = re.compile(r"[\x21-\x7e]?[^\x00-\x7f]+")
_SPACES = re.compile(r"\s+")
# Kinds of compatibility forms that are drawn like what they stand for. Superscripts, fractions, fonts and circles are not.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}
# Fixed values: <compat> forms whose shape is another one.
_OTHER_LOOK = set("ſ№℀℁℅℆ϐϑϕϖϰϱϵ")


class _Forms(dict):
    """Code point -> the text drawn like it, for str.translate; found when first asked for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in LOOKALIKES:
            out = LOOKALIKES[c]
        elif unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤ" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif c.isspace():
            out = " "
        elif unicodedata.decomposition(c).split(" ")[0] in _SAME_LOOK and c not in _OTHER_LOOK and not unicodedata.normalize("NFKC", c).startswith(" "):
            out = unicodedata.normalize("NFKC", c).translate(self)
        else:
            out = c
        self[code] = out
        return out


_FORMS = _Forms()
_steady: dict[str, bool] = {}


def _is_steady(segment: str) -> bool:
    """Quick check: the segment is composed, and none of its characters has another form."""
    known = _steady.get(segment)
    if known is None:
        known = unicodedata.is_normalized("NFC", segment) and segment.translate(_FORMS) == segment
        if len(_steady) < 100_000:
            _steady[segment] = known
    return known


def _segment(m: re.Match) -> str:
    text = m.group(0)
    if _is_steady(text):
        return text
    apart = unicodedata.normalize("NFD", text).translate(_FORMS)
    return unicodedata.normalize("NFC", apart)


def look(text: str | None) -> str | None:
    """What ``text`` looks like: texts that look the same have the same look; null stays null. For comparison only, as every look-alike letter is Latin in it.

    Only segments that fail the quick check are normalised, each with the
    character before it, and spliced into the text that is left as it is. Full-width
    letters, ligatures, no-break and other spaces, invisible characters,
    separate accents and look-alike letters are brought to the plain form; what a
    reader can tell apart (case, accents, punctuation, superscripts, fractions)
    stays. White space at the ends goes and a run of it becomes one space.
    """
    if text is None:
        return None
    if not text.isascii():
        text = _SEGMENT.sub(_segment, text)
        if not unicodedata.is_normalized("NFC", text):  # a mark that followed a removed character
            text = unicodedata.normalize("NFC", text)
    return _SPACES.sub(" ", text).strip()


# Scripts whose words are written in their own letters again, and how many letters that no Latin one resembles show that a word is theirs: single Greek letters are symbols.
_SCRIPTS = {"CYRILLIC": 1, "GREEK": 2, "ARMENIAN": 1}
_OWN: dict[str, dict[str, str]] = {s: {} for s in _SCRIPTS}
for _letter, _latin in LOOKALIKES.items():
    if (_name := unicodedata.name(_letter).split(" ")[0]) in _OWN:
        _OWN[_name].setdefault(_latin, _letter)
_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=10_000)
def _script(letter: str) -> str:
    """The script of a letter: LATIN, one of the above, or ''."""
    name = unicodedata.name(letter, "").split(" ")[0]
    return name if name == "LATIN" or name in _SCRIPTS else ""


def _word_script(word: str) -> str:
    """The script that a word of a look is in: '' if its letters leave it open, as they all have look-alikes."""
    plain = unicodedata.normalize("NFD", word)
    for script, least in _SCRIPTS.items():
        own = [c for c in plain if _script(c) == script]
        if len(own) >= least:
            rest = [c for c in plain if _script(c) == "LATIN"]
            return script if all(c in _OWN[script] for c in rest) else "LATIN"
    latin = [c for c in plain if _script(c) == "LATIN"]
    return "LATIN" if any(not any(c in own for own in _OWN.values()) for c in latin) else ""


def _in_script(word: str, script: str) -> str:
    apart = unicodedata.normalize("NFD", word)
    if any(_script(c) == "LATIN" and c not in _OWN[script] for c in apart):
        return word
    return unicodedata.normalize("NFC", "".join(_OWN[script].get(c, c) for c in apart))


def canonical(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null. Texts that look the same have the same form.

    It is the :func:`look`, with each word in one script: a word with letters
    that only Cyrillic, Greek or Armenian has is written in that script
    throughout, a word with letters that only Latin has in Latin. A word whose
    letters leave it open (``А.``, ``СССР``) is of the script of the next word
    that is clear, else of the one before it, else Latin.
    """
    seen = look(text)
    if seen is None or seen.isascii():
        return seen
    words = list(_WORDS.finditer(seen))
    scripts = [_word_script(m[0]) for m in words]
    if not any(s in _SCRIPTS for s in scripts):
        return seen
    for order in (range(len(scripts) - 2, -1, -1), range(1, len(scripts))):  # from the next clear word, then from the one before
        for i in order:
            if not scripts[i]:
                scripts[i] = scripts[i + 1 if order.step < 0 else i - 1]
    out, at = [], 0
    for m, script in zip(words, scripts):
        out += [seen[at : m.start()], _in_script(m[0], script) if script in _SCRIPTS else m[0]]
        at = m.end()
    return "".join([*out, seen[at:]])


def _udf(f):  # noqa: ANN001, ANN202
    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([f(t) for t in batch.to_pylist()], pa.string())

    return run


_canonical, _look = _udf(canonical), _udf(look)


def _beyond_ascii(text: Column, udf) -> Column:  # noqa: ANN001
    """``udf`` of the texts that need it: plain ASCII stays in the JVM."""
    plain = F.btrim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "), F.lit(" "))
    return F.when(text.rlike(r"[^\x00-\x7f]"), udf(text)).otherwise(plain)


def consistent_form(text: Column) -> Column:
    """:func:`canonical` as a column."""
    return _beyond_ascii(text, _canonical)


def look_of(text: Column) -> Column:
    """:func:`look` as a column."""
    return _beyond_ascii(text, _look)


def with_consistent_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """``df`` with, for each of ``columns``, its consistent form beside it."""
    return df.withColumns({f"{c}{suffix}": consistent_form(F.col(c)) for c in columns})


def same_look(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(fld, ref_id_a, ref_id_b): two rows, a < b, whose field differs in characters but has the same :func:`look`.

    Only looks with more than one spelling are followed: first their spellings
    are paired, then the rows of either spelling, so equal values make no pairs.
    Frequent spellings and looks are joined in parts. Nulls and fields without
    visible characters are no case.
    """
    # each distinct value is looked at once; a frequent value is one row before any shuffle
    parts = None
    for f in fields:
        one = df.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("raw")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("fld"), "raw", "n")
        parts = one if parts is None else parts.unionByName(one)
    spellings = staged(parts.withColumn("form", look_of(F.col("raw"))).where("form <> ''"), "forms")
    several = spellings.groupBy("fld", "form").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1").select("fld", "form")
    several = staged(spellings.join(several, ["fld", "form"]), "several")
    pairs = class_join(several.select("fld", "form", F.col("raw").alias("raw_a")), several.select("fld", "form", F.col("raw").alias("raw_b")), ["fld", "form"], "raw_a", "raw_b")
    pairs = staged(pairs.where("raw_a < raw_b").select("fld", "raw_a", "raw_b"), "pairs")
    rows = None
    for f in fields:
        one = df.where(F.col(f).isNotNull()).select(F.lit(f).alias("fld"), F.col(f).alias("raw"), F.col(row_id).cast("long").alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = staged(skew_join(rows, several.select("fld", "raw", "n"), ["fld", "raw"], "n", total), "looks")
    side = lambda x: rows.select("fld", F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"id_{x}"))
    first = class_join(pairs, side("a"), ["fld", "raw_a"], "raw_b", "id_a").select("fld", "raw_b", "id_a")
    both = class_join(staged(first, "first"), side("b"), ["fld", "raw_b"], "id_a", "id_b")
    return both.where("id_a <> id_b").select("fld", F.least("id_a", "id_b").alias("ref_id_a"), F.greatest("id_a", "id_b").alias("ref_id_b"))
