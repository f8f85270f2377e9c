"""Text normalisation. ASCII stays in the JVM; only texts with other characters go through Arrow to Python's Unicode tables."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"
_ASCII = r"\A\p{ASCII}*\z"
#: Letters of Latin-1 and Latin Extended-A, dashes and quotation marks.
_COMMON = [*map(chr, range(0xC0, 0x180)), *"–—‘’“”„«»"]
#: Rows of a batch that are Python strings at once.
_ROWS = 256
PUNCTUATION = r"""[\[\](){}'"?!;:,.]+"""


def fold_text(text: str, accents: bool) -> str:
    """Compatibility form, case folded, and without combining marks unless ``accents``."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return text if accents else unaccented(text)


class _Marks(dict):
    """For ``str.translate``: combining marks go, anything else stays."""

    def __missing__(self, code: int) -> int | None:
        found = self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return found


_MARKS = _Marks()


def unaccented(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_MARKS))


def _arrow(function):  # noqa: ANN001, ANN202
    def apply(texts: pa.Array) -> pa.Array:
        # some rows at a time are Python strings; a batch of long texts isn't
        parts = [pa.array([None if t is None else function(t) for t in texts.slice(at, _ROWS).to_pylist()], pa.string()) for at in range(0, len(texts), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    apply.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, "string")


def _latin(function):  # noqa: ANN001, ANN202
    """Pattern of texts of ASCII and such characters of ``_COMMON`` as ``function`` makes one character or two letters of, whatever stands beside them, and a column function that replaces these."""
    ones, longer = {}, {}
    for c in _COMMON:
        made = function(c)
        if len(made) == 1 and function(made) == made:
            ones[c] = made
        elif len(made) == 2 and made.isascii() and made.isalpha():
            longer[c] = made
    changed = {c: to for c, to in ones.items() if c != to}

    def column(text: Column) -> Column:
        for c, to in longer.items():
            text = F.replace(text, F.lit(c), F.lit(to))
        return F.translate(text, "".join(changed), "".join(changed.values()))

    return rf"\A[\x00-\x7f{_ranges(sorted(ones | longer))}]*\z", column


def _ranges(chars: list[str]) -> str:
    """Sorted characters as ranges of a pattern; a class of single characters is looked through one by one for each character of a text."""
    out: list[list[str]] = []
    for c in chars:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{a}-{b}" for a, b in out)


def _beyond_ascii(function, native):  # noqa: ANN001, ANN202
    """``native`` for ASCII; the same behind a table for the usual Latin letters and quotation marks, which have no context; else ``function`` in Python, which gets nulls for other rows."""
    pattern, mapped = _latin(function)

    def column(text: Column) -> Column:
        known = text.rlike(pattern)
        return F.coalesce(F.when(text.rlike(_ASCII), native(text)).when(known, native(mapped(text))), _arrow(function)(F.when(~known, text)))

    return column


#: NFKC, case folding, marks removed.
fold = _beyond_ascii(lambda t: fold_text(t, accents=False), F.lower)
#: NFKC and case folding.
fold_keeping_accents = _beyond_ascii(lambda t: fold_text(t, accents=True), F.lower)
#: Case folding, then marks removed, without the compatibility form.
fold_name = _beyond_ascii(lambda t: unaccented(t.casefold()), F.lower)
#: Marks removed, nothing else.
strip_accents = _beyond_ascii(unaccented, lambda c: c)


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(text, _EDGES, "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def for_matching(text: Column) -> Column:
    """Folded, cosmetic punctuation as blanks, squeezed; null stays null."""
    return squeeze(F.regexp_replace(fold(text), PUNCTUATION, " "))


def light(text: Column) -> Column:
    """Folded with accents kept, squeezed."""
    return squeeze(fold_keeping_accents(text))


def or_null(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once; inside lambdas, equal subexpressions aren't shared."""
    return F.element_at(F.transform(F.array(value), body), 1)
