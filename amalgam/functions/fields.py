"""Canonical fields from raw tags, as column expressions over (tags, format)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from amalgam.functions import text as X

#: For each field, the tags of each format that hold it, best first.
TAGS: dict[str, dict[str, str]] = {
    "doi": {"ris": "DO DI M3", "nbib": "AID LID", "wos": "DI D2", "bibtex": "doi", "endnote_tagged": "R"},
    "doi_url": {"ris": "UR L1 L2 L3 L4", "nbib": "UR", "bibtex": "url", "endnote_tagged": "U"},
    "pmid": {"ris": "PM", "nbib": "PMID", "wos": "PM", "endnote_tagged": "M"},
    "article_ids": {"nbib": "AID LID"},
    "pmcid": {"ris": "PMC", "nbib": "PMC"},
    "title": {"ris": "TI T1", "nbib": "TI", "wos": "TI", "bibtex": "title", "endnote_tagged": "T"},
    "author": {"ris": "AU A1", "nbib": "AU FAU", "wos": "AU AF", "bibtex": "author", "endnote_tagged": "A"},
    "year": {"ris": "PY Y1 DA", "nbib": "DP DEP DA", "wos": "PY", "bibtex": "year", "endnote_tagged": "D"},
    "journal_full": {"ris": "JF JO T2", "nbib": "JT", "wos": "SO", "bibtex": "journal", "endnote_tagged": "J B"},
    "journal_abbrev": {"ris": "JA J1 J2", "nbib": "TA", "wos": "J9 JI", "bibtex": "journaltitle shortjournal"},
    "volume": {"ris": "VL", "nbib": "VI", "wos": "VL", "bibtex": "volume", "endnote_tagged": "V"},
    "issue": {"ris": "IS", "nbib": "IP", "wos": "IS", "bibtex": "number", "endnote_tagged": "N"},
    "page_start": {"ris": "SP", "wos": "BP"},
    "page_end": {"ris": "EP", "wos": "EP"},
    "pages": {"nbib": "PG", "bibtex": "pages", "endnote_tagged": "P"},
    "abstract": {"ris": "AB N2", "nbib": "AB", "wos": "AB", "bibtex": "abstract", "endnote_tagged": "X"},
    "language": {"ris": "LA", "nbib": "LA", "wos": "LA", "bibtex": "language", "endnote_tagged": "G"},
    "publication_type": {"ris": "TY", "nbib": "PT", "wos": "DT PT", "bibtex": "__bibtex_entrytype", "endnote_tagged": "0"},
}
#: Formats whose names without a comma have the family last.
FAMILY_LAST = ("bibtex", "wos", "endnote_tagged")

_SUFFIX = r"(?i)\s+([JS]r\.?|I{2,3}|I?V)$"
_INITIALS = r"^[A-Z](?:\.?\s*[A-Z])*\.?$"
_DASH = r"\s*[–—]\s*"


def known_format(fmt: Column) -> Column:
    """The format, ``pubmed`` as ``nbib``; an unknown one is an error."""
    name = F.when(fmt == "pubmed", "nbib").otherwise(fmt)
    return F.when(name.isin("ris", "nbib", "wos", "bibtex", "endnote_tagged"), name).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), F.coalesce(fmt, F.lit("null")))))


def tag_names(field: str, fmt: Column) -> Column:
    """The tags of a field in order of preference; none where the format lacks it."""
    out = F.array().cast("array<string>")
    chosen = None
    for name, tags in TAGS[field].items():
        value = F.array(*map(F.lit, tags.split()))
        chosen = F.when(fmt == name, value) if chosen is None else chosen.when(fmt == name, value)
    return chosen.otherwise(out)


def numbered(tags: Column) -> Column:
    """tag, stripped value, value as it is, and index of each tag."""
    return F.transform(tags, lambda t, i: F.struct(t["tag"].alias("tag"), X.strip(t["value_raw_joined"]).alias("value"), t["value_raw_joined"].alias("whole"), i.alias("idx")))


def best(hits: Column, names: Column, where: Callable[[Column], Column] | None = None) -> Column:
    """The first non-empty hit by preference of its tag, then by place: (rank, idx, value, tag), or null."""
    wanted = F.filter(hits, lambda h: F.array_contains(names, h["tag"]) & (h["value"] != "") & (where(h) if where else F.lit(True)))
    return F.array_min(F.transform(wanted, lambda h: F.struct(F.array_position(names, h["tag"]).alias("rank"), h["idx"].alias("idx"), h["value"].alias("value"), h["tag"].alias("tag"))))


def earliest(hits: Column, names: Column, where: Callable[[Column], Column]) -> Column:
    """The first hit by place."""
    return F.get(F.filter(hits, lambda h: F.array_contains(names, h["tag"]) & where(h)), F.lit(0))


def every(hits: Column, names: Column) -> Column:
    """All non-empty hits by place."""
    return F.filter(hits, lambda h: F.array_contains(names, h["tag"]) & (h["value"] != ""))


def doi(value: Column) -> Column:
    """A DOI without resolver, prefix, suffix and trailing punctuation, percent-decoded, in lower case; null if it doesn't begin with 10."""
    d = X.strip(F.regexp_replace(X.strip(value), r"(?i)\s*\[doi\]\s*$", ""))
    path = F.regexp_replace(F.regexp_extract(d, r"^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    d = F.when(d.rlike("^https?://"), F.regexp_replace(path, "^/+", "")).otherwise(d)
    d = F.regexp_replace(d, r"(?i)^(doi:|doi\.org/|dx\.doi\.org/)", "")
    escaped = F.replace(F.regexp_replace(d, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    d = F.lower(X.strip(F.regexp_replace(F.coalesce(F.try_url_decode(escaped), d), r"[.,;]+$", "")))
    return F.when(d.startswith("10."), d)


def doi_in_url(value: Column) -> Column:
    return X.or_null(F.regexp_extract(value, r"doi\.org/([^?#\s]+)", 1))


def year(value: Column) -> Column:
    """The first year of the 20th or 21st century in a text."""
    return X.or_null(F.regexp_extract(value, r"(?U)\b(?:19|20)\d{2}\b", 0)).cast("int")


def _first_letters(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), "")


def author(name: Column, fmt: Column) -> Column:
    """family, given, initials, suffix and raw of one name."""
    raw = X.strip(name)
    before, rest = X.strip(F.substring_index(raw, ",", 1)), X.strip(F.regexp_extract(raw, r"(?s)^[^,]*,(.*)$", 1))
    parts = X.words(raw)
    n = F.size(parts)
    comma, only_initials, last = raw.contains(","), rest.rlike(_INITIALS), fmt.isin(*FAMILY_LAST)
    without = F.when(last, F.slice(parts, 1, n - 1)).otherwise(F.slice(parts, 2, n))
    text = "string"
    return F.struct(
        F.when(comma, X.strip(F.regexp_replace(before, _SUFFIX, ""))).when((n > 1) & last, F.element_at(parts, -1)).otherwise(F.get(parts, F.lit(0))).alias("family"),
        F.when(comma, F.when(~only_initials, rest)).when(n > 1, F.array_join(without, " ")).cast(text).alias("given"),
        F.when(comma, F.when(only_initials, F.regexp_replace(rest, "[^A-Z]", "")).when(rest != "", _first_letters(X.words(rest)))).when(n > 1, _first_letters(without)).cast(text).alias("initials"),
        F.when(comma, X.or_null(F.regexp_extract(before, _SUFFIX, 1))).cast(text).alias("suffix"),
        raw.alias("raw"),
    )


def is_elocator(pages: Column) -> Column:
    return pages.rlike(r"(?i)^e\d+")


def long_pages(pages: Column) -> Column:
    """Dashes as hyphens, without blanks."""
    return F.replace(F.regexp_replace(pages, _DASH, "-"), F.lit(" "), F.lit(""))
