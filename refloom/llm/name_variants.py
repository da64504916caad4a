"""Variant spellings of the names of people and organisations, linked by a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.packed import plain
from refloom.llm.class_pairs import class_join
from refloom.llm.edit_metric import radius_join, to_roots
from refloom.operators.packed_values import value_counts
from refloom.session import skew_join, staged

# Given names and their usual short forms.
SHORT_FORMS = {
    "alexander": "alex sasha sandy al lex xander", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony ant", "antonio": "toni tonio", "benjamin": "ben benny", "catherine": "cathy kate cat",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "christine": "chris tina", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dmitri": "dima mitya dimitri", "donald": "don donnie",
    "dorothy": "dot dottie", "edward": "ed eddie ned", "elizabeth": "liz beth betty eliza lizzie lisa bess", "francisco": "paco pancho fran cisco", "frederick": "fred freddy", "gabriel": "gabe", "george": "georgie",
    "gerald": "gerry jerry", "giovanni": "gianni vanni", "gregory": "greg", "guadalupe": "lupe lupita", "harold": "harry hal", "henry": "harry hank", "hugo": "huey", "ingrid": "inga", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "johannes": "hans jan johan", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey jo", "joshua": "josh", "katherine": "kate kathy katie kat kathie", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len leo lenny",
    "margaret": "peggy maggie meg greta marge", "matthew": "matt matty", "michael": "mike mick mickey misha", "nicholas": "nick nicky nico klaus", "oriol": "uri", "pamela": "pam pammy", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete",
    "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue susie suzy", "tatiana": "tanya tania",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky vicki tori", "vincent": "vince vin vinnie", "walter": "walt wally", "william": "bill will billy willy liam", "wolfgang": "wolf", "zofia": "zosia sophie",
}
# Shortened words in the names of organisations.
ORG_WORDS = {"inst": "institute", "sem": "seminar", "ctr": "centre", "center": "centre", "dept": "department", "dep": "department", "univ": "university", "wkg": "working", "grp": "group", "gp": "group", "wg": "working group", "lab": "laboratory", "soc": "society", "acad": "academy"}
_LINKS = {"of", "for", "on", "at", "and"}


# Letters that no accent separates.
_WHOLE = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "ı": "i", "æ": "ae"})
_CLEAN = re.compile(r"[A-Za-z0-9.,]+(?: [A-Za-z0-9.,]+)*")
_WORDS, _NO_WORD, _POINT = re.compile(r"\w+"), re.compile(r"\W+"), re.compile(r"\.(?=\w)")
_GAPS, _OTHER = re.compile(r"[\s_-]+"), re.compile(r"[^\w,. ]+")


def folded(name: str) -> str:
    """``name`` in lower case without accents, look-alikes and anything that is neither letter, digit, comma, point nor space."""
    if _CLEAN.fullmatch(name):
        return name
    text = name
    if not name.isascii():
        text = unicodedata.normalize("NFKD", plain(name).translate(_WHOLE))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _OTHER.sub("", _GAPS.sub(" ", text.replace("&", " and "))).strip()


def _initials(token: str, cased: str, others: int) -> str:
    """The initials that ``token`` writes together or with a point, or '' if it is a word."""
    bare = token.replace(".", "")
    if len(bare) == 1 or ("." in token and len(bare) <= 3 and token.count(".") >= len(bare)):
        return bare
    if others and len(bare) in (2, 3) and cased.replace(".", "").isupper() and not set(bare) & set("aeiouy") or (others and len(bare) == 2 and not cased.istitle()):
        return bare
    return ""


@lru_cache(maxsize=100_000)
def parse(name: str) -> tuple[bool, str, str, str, bool]:
    """(is an organisation, family or whole name, given, further initials, order is sure).

    Where the order of a family and a given name is not sure, they stand as written.
    """
    text = folded(name)
    lower = text.lower()
    words = _WORDS.findall(lower)
    if len(words) >= 5 or (set(words[1:-1]) & _LINKS):
        whole = " ".join(ORG_WORDS.get(w, w) for w in words)
        return True, whole[4:] if whole.startswith("the ") else whole, "", "", True
    if "," in text:
        family, _, given = (p.strip() for p in text.partition(","))
        parts = given.replace(".", ". ").split()
        marks = [(_initials(p.lower(), p, 1), p.lower().strip(".")) for p in parts]
        first = (marks[0][0] or marks[0][1]) if marks else ""
        rest = "".join(m[0] or m[1][:1] for m in marks[1:])
        if marks and marks[0][0]:
            first, rest = first[:1], first[1:] + rest
        return False, _NO_WORD.sub("", family.lower()), first, rest, True
    parts = _POINT.sub(". ", text).split()
    marks = [(_initials(p.lower(), p, len(parts) - 1), _NO_WORD.sub("", p.lower())) for p in parts]
    if not marks:
        return False, _NO_WORD.sub("", lower), "", "", True
    if len(marks) == 1:
        return False, marks[0][1], "", "", True
    full = [m for m in marks if not m[0]]
    short = "".join(m[0] for m in marks if m[0])
    if len(full) == 1:
        return False, full[0][1], short[:1], short[1:], True
    if not full:
        return False, marks[-1][1], short[:1], short[1:-1], True
    return False, full[-1][1], full[0][1], short + "".join(m[1][:1] for m in full[1:-1]), False


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        rows = [parse(n) for n in names]
        kinds = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), batch.column(1)], ["name", "org", "family", "given", "rest", "sure", "n"])


_FULL: dict[str, str] = {}
for _name, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        _FULL.setdefault(_s, _name)


_USUAL = sorted({*SHORT_FORMS, *_FULL})


def spellings(citations: DataFrame, flags: DataFrame) -> DataFrame:
    """(name, n): the distinct non-empty names, and how often each is written."""
    split = value_counts(citations, "author", "preprint_folder").withColumnRenamed("val", "name")
    for c in ("first_author_cited", "first_author_registered"):
        split = split.unionByName(flags.select(F.regexp_replace(c, r"(?U)^\s+|\s+$", "").alias("name"), F.lit(1).cast("long").alias("n")))
    return split.where("name is not null and name <> ''").groupBy("name").agg(F.sum("n").alias("n"))


def _oriented(people: DataFrame) -> DataFrame:
    """People whose order of names was not sure, put in the order that the whole corpus supports.

    A word counts as family or given name as often as distinct spellings of sure
    order use it so; a spelling is turned round if that fits better.
    """
    sure = people.where("sure and given <> ''")
    roles = sure.select(F.col("family").alias("word"), F.lit(1).alias("as_family"), F.lit(0).alias("as_given")).unionByName(sure.where(F.length("given") > 1).select(F.col("given").alias("word"), F.lit(0).alias("as_family"), F.lit(1).alias("as_given")))
    roles = roles.groupBy("word").agg(F.sum("as_family").alias("f"), F.sum("as_given").alias("g"))
    open_ = staged(people.where("not sure"), "unsure")
    used = open_.select(F.explode(F.array("family", "given")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    roles = staged(roles.join(used, "word"), "roles")
    total = open_.count()
    # positive: rather a family name; negative: rather a given name
    lean = F.log((F.col("f") + 0.5) / (F.col("g") + 0.5)).alias("lean")
    lookup = lambda c: roles.select(F.col("word").alias(c), lean.alias(f"{c}_seen"), "n")
    out = skew_join(open_.withColumnRenamed("n", "times"), lookup("family"), ["family"], "n", total, "left")
    out = skew_join(out, lookup("given"), ["given"], "n", total, "left")
    # a usual given name counts as if it had been seen some more times
    lean_of = lambda c: F.coalesce(f"{c}_seen", F.lit(0.0)) - F.when(F.col(c).isin(*_USUAL), 2.0).otherwise(0.0)
    turn = lean_of("given") > lean_of("family")
    turned = out.select("name", "org", F.when(turn, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(turn, F.col("family")).otherwise(F.col("given")).alias("given"), "rest", "sure", F.col("times").alias("n"))
    return people.where("sure").unionByName(turned)


def name_entities(names: DataFrame) -> DataFrame:
    """(name, entity): each spelling of ``names`` (name, n) and the person or organisation it stands for.

    1. Families (and whole names of organisations) within one edit are joined by
       :func:`radius_join`; a rare one goes to its most frequent neighbour, and
       on to that one's, until none is more frequent.
    2. Within a family, full given names within one edit, or a short and its
       full form, are one person; the most frequent form names it. Which given
       names are near each other is found once for all families.
    3. A spelling with initials goes to the person whose name, or short name,
       has them, one without given name to the family's most frequent person.
    """
    parsed = staged(names.select("name", "n").mapInArrow(_parse_all, "name string, org boolean, family string, given string, rest string, sure boolean, n long"), "parsed")
    people = _oriented(parsed.where("not org and family <> ''")).unionByName(parsed.where("org and family <> ''"))
    full_form = F.create_map(*[F.lit(x) for kv in _FULL.items() for x in kv])
    people = people.withColumn("formal", F.coalesce(F.try_element_at(full_form, F.col("given")), F.col("given"))).withColumn("kin", F.concat(F.when(F.col("org"), "o:").otherwise("p:"), F.when(F.col("org"), F.col("family")).otherwise(F.replace("family", F.lit("ph"), F.lit("f")))))
    people = staged(people, "people")

    # 1: families, ph written as f; people and organisations apart
    kin = staged(people.groupBy("kin").agg(F.sum("n").alias("w"), F.collect_set(F.substring("formal", 1, 1)).alias("letters")), "kin")
    near = staged(radius_join(kin.where("kin like 'p:%'"), "kin", 1).unionByName(radius_join(kin.where("kin like 'o:%'"), "kin", 1)), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    w = lambda x: kin.select(F.col("kin").alias(x), F.col("w").alias(f"w_{x}"), F.col("letters").alias(f"letters_{x}"))
    up = both.join(w("a").hint("merge"), "a").join(w("b").hint("merge"), "b").where((F.col("w_b") > F.col("w_a")) | ((F.col("w_b") == F.col("w_a")) & (F.col("b") < F.col("a"))))
    up = up.where(F.arrays_overlap("letters_a", "letters_b") | F.array_contains("letters_a", "") | F.array_contains("letters_b", ""))
    up = up.groupBy("a").agg(F.max_by("b", F.struct("w_b", "b")).alias("b"))
    roots = to_roots(up, "a", "b").select(F.col("a").alias("kin"), F.col("b").alias("root"))
    people = staged(people.join(roots, "kin", "left").withColumn("root", F.coalesce("root", "kin")), "rooted")

    # 2: persons of a family, by their full given names
    persons = people.where(F.length("formal") > 1).groupBy("root", "formal").agg(F.sum("n").alias("w"), F.collect_set(F.substring("given", 1, 1)).alias("letters"), F.collect_set(F.when(F.col("rest") != "", F.substring("rest", 1, 1))).alias("mids"))
    persons = staged(persons, "persons")
    alike = radius_join(persons, "formal", 1)
    alike = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = persons.select("root", F.col("formal").alias("other"), F.col("w").alias("w_other"))
    typo = persons.select("root", "formal", "w").join(alike.select(F.col("a").alias("formal"), F.col("b").alias("other")), "formal").join(other.hint("merge"), ["root", "other"])
    typo = typo.where((F.col("w_other") > F.col("w")) | ((F.col("w_other") == F.col("w")) & (F.col("other") < F.col("formal"))))
    typo = typo.groupBy("root", "formal").agg(F.max_by("other", F.struct("w_other", "other")).alias("other"))
    # a family's given name as one text, so that its links are followed within the family
    named = lambda c: F.concat_ws("|", "root", c)
    ends = to_roots(typo.select(named("formal").alias("at"), named("other").alias("to")), "at", "to")
    typo = ends.select(F.col("at").alias("who"), F.substring_index("to", "|", -1).alias("person"))
    people = people.withColumn("who", named("formal")).join(typo.hint("merge"), "who", "left").drop("who").withColumn("person", F.coalesce("person", F.when(F.length("formal") > 1, F.col("formal"))))
    heads = persons.withColumn("who", named("formal")).join(typo, "who", "left_anti")

    # 3: initials, and no given name at all
    known = F.create_map(*[F.lit(x) for full, shorts in SHORT_FORMS.items() for x in (full, "".join(sorted({s[0] for s in shorts.split()})))])
    written = F.array_union("letters", F.array(F.substring("formal", 1, 1)))
    usual = F.array_except(F.split(F.coalesce(F.try_element_at(known, F.col("formal")), F.lit("")), ""), written)
    marks = F.array_union(F.transform(written, lambda x: F.struct(x.alias("letter"), F.lit(1).alias("written"))), F.transform(usual, lambda x: F.struct(x.alias("letter"), F.lit(0).alias("written"))))
    lettered = heads.select("root", F.col("formal").alias("head"), "w", "mids", F.explode(marks).alias("m")).select("root", "head", "w", "mids", "m.letter", "m.written").where("letter <> ''")
    short = people.where("person is null").select("name", "root", F.col("formal").alias("letter"), "rest")
    # the best person of a family and letter: one with the further initial, one without any, or just any; each is found before names are looked up
    best = lambda rows, keys, extra: rows.groupBy(*keys).agg(F.max(F.struct((F.col("written") + extra).alias("fit"), "w", "head")).alias("best"))
    with_mid = best(lettered.withColumn("mid", F.explode("mids")), ["root", "letter", "mid"], 3).withColumnRenamed("best", "b1")
    no_mid = best(lettered.where(F.size("mids") == 0), ["root", "letter"], 1).withColumnRenamed("best", "b2")
    anyone = best(lettered, ["root", "letter"], 0).withColumnRenamed("best", "b3")
    rest = F.substring("rest", 1, 1)
    of_letter = short.where("letter <> ''").withColumn("mid", rest).join(anyone.join(no_mid, ["root", "letter"], "left"), ["root", "letter"]).join(with_mid, ["root", "letter", "mid"], "left")
    by_letter = of_letter.select("name", F.when(F.col("mid") == "", F.col("b3")).otherwise(F.greatest("b1", "b2", "b3"))["head"].alias("found"))
    by_family = short.where("letter = ''").join(heads.groupBy("root").agg(F.max_by("formal", F.struct("w", "formal")).alias("found")), "root").select("name", "found")
    people = people.join(by_letter.unionByName(by_family).hint("merge"), "name", "left")
    return people.select("name", F.concat_ws("|", "root", F.coalesce("person", "found", F.col("formal"))).alias("entity"))


def variant_pairs(citations: DataFrame, flags: DataFrame) -> DataFrame:
    """(name_a, name_b): two spellings, a < b by code point, of the same person or organisation.

    Null and blank names and those without a letter or digit are no spelling; a
    spelling counts once however often it is written. See :func:`name_entities`.
    """
    entities = staged(name_entities(spellings(citations, flags)), "entities")
    b = entities.select("entity", F.col("name").alias("name_b"))
    return class_join(entities.withColumnRenamed("name", "name_a"), b, ["entity"], "name_a", "name_b").where("name_a < name_b").select("name_a", "name_b")
