"""Matching keys and quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amalgam.functions import text as X

MIN_TOKEN = 3
#: Publication types, whole and in lower case, and words of titles that mark notices.
_ERRATUM_TYPE, _ERRATUM = r"^(addendum|correction|corrigendum|(published )?erratum)$", r"(?iU)\b(addendum|correction|corrigendum|erratum|errata)\b"
_RETRACTION_TYPE, _RETRACTION = r"^(withdrawal|retracted publication|retraction( of publication)?)$", r"(?iU)\b(withdrawal|retract(ed|ion))\b"
_CORRECTED_TYPE = r"^corrected and republished( article)?$"


def long_tokens(text: Column) -> Column:
    """Words of at least ``MIN_TOKEN`` characters, repeats included."""
    return F.filter(X.words(text), lambda w: F.length(w) >= MIN_TOKEN)


def shingles(text: Column) -> Column:
    """Long words, then pairs of neighbours among them; null if there are none."""
    none = F.array().cast("array<string>")

    def both(tokens: Column) -> Column:
        n = F.size(tokens)
        pairs = F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n), lambda x, y: F.concat_ws(" ", x, y))).otherwise(none)
        return F.when(n > 0, F.concat(tokens, pairs))

    return X.let(long_tokens(text), both)


def with_part(title: Column, part: Column) -> Column:
    """Both, joined by a bar, if both are there."""
    part = part.cast("string")
    return F.when((title != "") & (part != ""), F.concat_ws("|", title, part))


def matching_keys(title: Column, year: Column, first_author: Column, journal: Column) -> Column:
    strict = X.or_null(title)
    return F.struct(
        strict.alias("title_key_strict"),
        with_part(strict, F.when(year != 0, year)).alias("title_year_key"),
        with_part(strict, first_author).alias("title_first_author_key"),
        with_part(strict, journal).alias("title_journal_key"),
        X.squeeze(F.replace(strict, F.lit("-"), F.lit(" "))).alias("title_key_fuzzy"),
        shingles(strict).alias("title_shingles"),
        F.lit(None).cast("string").alias("title_minhash"),
        F.lit(None).cast("string").alias("title_simhash"),
    )


def is_truncated(title: Column) -> Column:
    """Whether a title shows that something is missing."""
    return F.coalesce(title.contains("...") | title.endswith("…") | F.lower(title).contains("[truncated]"), F.lit(False))


def _has_type(types: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(types, lambda t: F.lower(t).rlike(pattern)), F.lit(False))


def quality_flags(doi: Column, pmid: Column, title: Column, authors: Column, year: Column, pages_unreliable: Column, types: Column) -> Column:
    n = F.size(F.coalesce(authors, F.array().cast(f"array<{_AUTHOR}>")))
    nameless = F.size(F.filter(authors, lambda a: F.coalesce(a["family"], F.lit("")) == ""))
    says = lambda pattern: F.coalesce(title.rlike(pattern), F.lit(False))
    return F.struct(
        doi.isNotNull().alias("doi_present"),
        pmid.isNotNull().alias("pmid_present"),
        (F.coalesce(X.strip(title), F.lit("")) == "").alias("title_missing"),
        is_truncated(title).alias("title_truncated"),
        (n == 0).alias("authors_missing"),
        F.coalesce((n > 0) & (nameless > F.floor(n / 2)), F.lit(False)).alias("authors_incomplete"),
        year.isNull().alias("year_missing"),
        F.coalesce(pages_unreliable, F.lit(False)).alias("pages_unreliable"),
        (_has_type(types, _ERRATUM_TYPE) | says(_ERRATUM)).alias("is_erratum_notice"),
        (_has_type(types, _RETRACTION_TYPE) | says(_RETRACTION)).alias("is_retraction_notice"),
        _has_type(types, _CORRECTED_TYPE).alias("is_corrected_republished"),
        F.lit(False).alias("has_linked_citation"),
    )


_AUTHOR = "struct<family:string,given:string,initials:string,suffix:string,raw:string>"
