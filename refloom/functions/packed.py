"""Splitting one field that holds several values. Plain Python, used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from refloom.functions.lookalikes import FOLD

# The delimiters that are tried, strongest first.
DELIMITERS = {"name": ["semicolon", "bar", "newline", "slash", "and", "comma"], "code": ["semicolon", "bar", "newline", "slash", "comma", "space"]}
_MARK = {"semicolon": r";", "bar": r"\|", "newline": r"[\r\n]", "slash": r"\s/\s", "and": r",?\s+(?:and|AND|And|und|et|y|&)\s+", "comma": r",", "space": r"\s+"}
#: What a field must hold (in Java's syntax) to be more than one value.
PACKED = {"name": r"(?U)[;|\r\n,]|[\s\x1c-\x1f]/[\s\x1c-\x1f]|[\s\x1c-\x1f](?:and|AND|And|und|et|y|&)[\s\x1c-\x1f]", "code": r"(?U)[;|,\s\x1c-\x1f]"}

_AND_WORDS = frozenset({"and", "AND", "And", "und", "et", "y", "&"})
_SIGN = {n: re.compile(m if n != "and" else r"\s(?:and|AND|And|und|et|y|&)\s") for n, m in _MARK.items()}
_HOLE = "\U000f0000"  # stands for a quoted or braced part
_HIDDEN = re.compile(r'\{[^{}]*\}|"[^"]*"|' + _HOLE)
# A remark that further authors follow is not a value.
_REMARK = re.compile(r"(?:[\s,;|/&]|\band\b)*(?:\bet\s+al\b|\band\s+others\b|\bothers\b|\bu\.\s?a\.)[\s;,.|/]*$", re.I)
_HINT = re.compile(r"al\b|others|a\.\s*$", re.I)
# What may stand behind a remark.
_AFTER = ";,.|/" + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s-]?){1,4}$")
_GIVEN = re.compile(r"\S+(?:\s[^\W\d_]\.?)*$")
_WORD = r"(?:[^\W\d_a-z]['’\w]*\.?|[a-z]['’]?[^\W\d_a-z]\w+)(?:-\w+\.?)*"
# Small words that belong to a family name.
_SMALL = r"(?:(?:van|von|de|der|den|del|della|di|da|du|dos|la|le|ten|ter|zu)\s)"
_PERSON = re.compile(rf"(?:{_WORD}\s{_SMALL}{{0,2}}{_WORD}(?:\s{_WORD}){{0,3}}|{_SMALL}{{0,2}}{_WORD},\s*{_WORD}(?:\s{_WORD}){{0,3}})$")
_BODY = re.compile(r".*\s(?:of|on|for|at|OF|ON|FOR|AT)\s", re.S)
_AND = re.compile(r"\s(?:and|AND|And|und|et|y|&)\s")
_CODE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*$")
_EDGE = ' \t\r\n;,|"{}'
# Words for institutions, and for the parts of one that are named behind it.
INSTITUTIONS = ["university", "université", "universität", "universidad", "università", "institute", "college", "academy", "observatory", "laboratory", "hospital"]
UNITS = ["department", "dept", "faculty", "school", "division", "section", "institute", "laboratory", "group", "centre", "center", "chair", "branch"]

# Anything but ASCII and accented Latin letters, which are already plain.
_UNUSUAL = re.compile(r"[^\x00-\x7fÀ-ıĴ-ňŊ-ž]")


def plain(text: str) -> str:
    """``text`` as a reader sees it: compatibility forms, invisible characters and look-alikes undone."""
    if text.isascii() or not _UNUSUAL.search(text):
        return text
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return text.translate(FOLD)


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter added, left out, replaced or swapped with its neighbour makes ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[at:], b[at:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


@lru_cache(maxsize=100_000)
def _means(word: str, institutions: bool) -> bool:
    """Whether ``word`` is one of the words for institutions or units: as it is, shortened with a point, or misspelt by one edit."""
    low = word.lower()
    for known in INSTITUTIONS if institutions else UNITS:
        if low == known or (low[-1:] == "." and len(low) > 4 and known.startswith(low[:-1])) or (low[-1:] == "." and low[:-1] == known) or (len(low) > 5 and _one_edit(low, known)):
            return True
    return False


def _masked(text: str) -> tuple[str, list[str]]:
    """``text`` with each quoted or braced part as one character, and those parts in order."""
    if '"' not in text and "{" not in text and _HOLE not in text:
        return text, []
    parts = _HIDDEN.findall(text)
    return _HIDDEN.sub(_HOLE, text), parts


def _tidy(piece: str) -> str:
    """Without white space, quotes, braces and left-over delimiters around it."""
    piece = piece.strip()
    if piece[:1].isalnum() and (piece[-1] == "." or piece[-1].isalnum()):
        return piece
    last = None
    while piece != last:
        last = piece
        piece = piece.strip().strip(_EDGE)
        if len(piece) > 1 and piece[0] in "'‘" and piece[-1] in "'’":
            piece = piece[1:-1]
    return piece


def _rejoined(pieces: list[str]) -> list[str]:
    """Undo cuts at commas that belong to a value: ``Family, Given``, and an institution before its unit."""
    out, i = [], 0
    while i < len(pieces):
        if i + 1 < len(pieces):
            after = plain(pieces[i + 1])
            if after[:1].isspace():
                a, b = plain(pieces[i]).split(), after.split()
                if a and b and _HOLE not in pieces[i] and _HOLE not in after:
                    family = len(a) == 1 and (_INITIALS.match(rest := " ".join(b)) or _GIVEN.match(rest))
                    if family or (len(b) > 2 and _means(a[-1], True) and _means(b[0], False)):
                        out.append(f"{pieces[i]},{pieces[i + 1]}")
                        i += 2
                        continue
        out.append(pieces[i])
        i += 1
    return out


@lru_cache(maxsize=200_000)
def _typed(piece: str, kind: str) -> bool:
    """Whether the piece alone has the form of a value: a code, a person, or a body such as ``Centre of X and Y``."""
    seen = " ".join(plain(piece).split())
    if kind == "code":
        return bool(_CODE.match(seen))
    if _PERSON.match(seen):
        return True
    if not _BODY.match(seen + " "):
        return False
    head, comma, _ = seen.partition(",")
    if comma and not _means(head.rpartition(" ")[2], True):
        return False
    last = _AND.split(seen)[-1]
    return last == seen or not _PERSON.match(last)


def _remarked(text: str) -> bool:
    """Whether the text may end in a remark; most do not, which is told by the end alone."""
    end = text.rstrip(_AFTER)[-6:].casefold()
    return (end.endswith(("al", "others")) or (end.endswith("a") and "u." in end)) and bool(_HINT.search(text))


def _present(text: str, kind: str) -> tuple[str, ...]:
    """The delimiters that occur in ``text``; an expression is searched only where its characters or words are there."""
    found = []
    if ";" in text:
        found.append("semicolon")
    if "|" in text:
        found.append("bar")
    if "\n" in text or "\r" in text:
        found.append("newline")
    if "/" in text and _SIGN["slash"].search(text):
        found.append("slash")
    if kind == "name" and not _AND_WORDS.isdisjoint(text.split()) and _SIGN["and"].search(text):
        found.append("and")
    if "," in text:
        found.append("comma")
    if kind == "code" and _SIGN["space"].search(text):
        found.append("space")
    return tuple(found)


@lru_cache(maxsize=100_000)
def _judged(piece: str, kind: str) -> tuple[str, bool]:
    """A piece without what stands around it, and whether that has the form of a value."""
    q = _tidy(piece)
    return q, bool(q) and _typed(q, kind)


@lru_cache(maxsize=1000)
def _cutter(combo: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_MARK[n] for n in combo))


class Field:
    """One field made ready to be cut: its shape, the delimiters present, and its pieces under any of their combinations."""

    def __init__(self, field: str, kind: str):
        self.kind = kind
        if kind == "code" and "'" in field and '"' not in field:
            field = re.sub(r"'([^']*)'", r'"\1"', field)
        text, parts = _masked(field)
        if kind == "name" and _remarked(text):
            text = _REMARK.sub("", text)
        text = text.strip()
        if kind == "code" and text[:1] == "[" and text[-1:] == "]":
            text = text[1:-1]
        self.text, self.parts = text, parts
        self.quoted = {_tidy(p) for p in parts} if parts else ()
        inner = text.strip(" ;|\n\r,")
        self.present = _present(inner, kind) if inner else ()

    @property
    def shape(self) -> str:
        """The delimiters present, and whether the text before the first comma is one word, as where family names stand first."""
        inverted = "comma" in self.present and self.kind == "name" and " " not in self.text.partition(",")[0].strip()
        return "+".join(self.present) + ("/i" if inverted else "")

    def combos(self) -> list[tuple[str, ...]]:
        """The candidates: every delimiter alone, and the strongest two, three and so on together, as a field may mix them."""
        return [(n,) for n in self.present] + [self.present[:k] for k in range(2, len(self.present) + 1)]

    def cut(self, combo: Sequence[str]) -> tuple[list[str], float]:
        """The pieces under ``combo``, and the share of them that look like a value. Quoted and braced parts are never cut."""
        raw = self._raw(combo)
        # a piece in which another delimiter is left is not one value
        left = [_SIGN[n] for n in self.present if n not in combo and n not in ("comma", "space", "and")] if self.kind == "name" else ()
        lone = self.kind == "name" and "and" in self.present and "and" not in combo
        hidden, out, good = iter(self.parts), [], 0
        if not self.parts and not left:
            for p in raw:
                q, typed = _judged(p, self.kind)
                if q:
                    out.append(q)
                    good += typed and not (lone and _AND.search(p) and not _BODY.match(p + " "))
            return out, good / len(out) if out else 0.0
        for p in raw:
            shown = re.sub(_HOLE, lambda m: next(hidden), p) if self.parts and _HOLE in p else p
            q = _tidy(shown)
            if not q:
                continue
            out.append(q)
            if q in self.quoted:
                good += 1
            elif not (left and any(s.search(p.strip()) for s in left)) and not (lone and _AND.search(p) and not _BODY.match(p + " ")):
                good += _typed(q, self.kind)
        return out, good / len(out) if out else 0.0

    def _raw(self, combo: Sequence[str]) -> list[str]:
        raw = _cutter(tuple(combo)).split(self.text)
        return _rejoined(raw) if self.kind == "name" and "comma" in combo else raw

    def pieces(self, combo: Sequence[str]) -> list[str]:
        """The pieces under ``combo``, as of :meth:`cut`."""
        if self.parts:
            return self.cut(combo)[0]
        return [q for p in self._raw(combo) if (q := _tidy(p))]

    def first(self, combo: Sequence[str]) -> tuple[str, bool] | None:
        """The first piece under ``combo``, and whether it looks like a value."""
        raw = _cutter(tuple(combo)).split(self.text.lstrip(_EDGE), maxsplit=2)
        if self.kind == "name" and "comma" in combo:
            raw = _rejoined(raw[:2])
        left = [_SIGN[n] for n in self.present if n not in combo and n not in ("comma", "space", "and")]
        hidden = iter(self.parts)
        q = _tidy(re.sub(_HOLE, lambda m: next(hidden), raw[0]) if self.parts and _HOLE in raw[0] else raw[0])
        if not q:
            return None
        lone = "and" in self.present and "and" not in combo and _AND.search(raw[0]) and not _BODY.match(raw[0] + " ")
        return q, q in self.quoted or (not any(s.search(raw[0].strip()) for s in left) and not lone and _typed(q, self.kind))

    def single(self) -> list[str]:
        """The value of a field without delimiters."""
        hidden = iter(self.parts)
        one = _tidy(re.sub(_HOLE, lambda m: next(hidden), self.text) if self.parts else self.text)
        return [one] if one else []


def name_of(combo: Sequence[str]) -> str:
    return "+".join(combo)


def decide(field: Field, order: Sequence[str] = ()) -> tuple[list[str], bool]:
    """The pieces of a field, and whether its source's choice stood.

    ``order`` names candidates by their source's score, the best first. The best
    stands if all its pieces look like values. Otherwise the field's own
    candidates are compared: the most regular one is taken, among equals the
    source's order decides, then fewer and stronger delimiters.
    """
    if not field.present:
        return field.single(), True
    if len(field.present) == 1:
        return field.pieces(field.present), True
    combos = {name_of(c): c for c in field.combos()}
    first = next((n for n in order if n in combos), None)
    if first is not None:
        pieces, regular = field.cut(combos[first])
        if regular == 1:
            return pieces, True
    place = {n: i for i, n in enumerate(order)}
    best, best_rank, best_name = [], None, None
    for i, (n, combo) in enumerate(combos.items()):
        pieces, regular = field.cut(combo)
        rank = (-round(regular, 2), place.get(n, len(place)), len(combo), i)
        if best_rank is None or rank < best_rank:
            best, best_rank, best_name = pieces, rank, n
    return best, best_name == first


def settled(cuts: Sequence[tuple[list[str], float]]) -> list[str] | None:
    """The pieces that :func:`decide` takes of the ``cuts`` of a field, (pieces, regular) for each candidate, or None if that depends on the source's order.

    The most regular cut is taken, and a source's choice that stands is one of
    these; so the order decides only between equally regular cuts that differ.
    """
    top = max(round(regular, 2) for _, regular in cuts)
    best = [pieces for pieces, regular in cuts if round(regular, 2) == top]
    return best[0] if all(pieces == best[0] for pieces in best[1:]) else None


def values(field: str | None, kind: str, order: Sequence[str] = ()) -> list[str]:
    """The values of one field in order; a field without delimiter is one value."""
    return [] if field is None else decide(Field(field, kind), order)[0]


def first_value(field: str, kind: str = "name") -> str:
    """The first value of a field, or '', without cutting the rest of a long one: the first piece, under the strongest delimiters that make it look like a value."""
    made = Field(field, kind)
    if not made.present:
        return next(iter(made.single()), "")
    kept = ""
    for combo in made.combos():
        piece = made.first(combo)
        if piece is None:
            continue
        kept = kept or piece[0]
        if piece[1]:
            return piece[0]
    return kept
