"""Canonical fields, keys, flags and provenance of parsed records, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import fields as E
from amalgam.functions import keys as K
from amalgam.functions import text as X
from amalgam.schema import CANON, CANON_FIELDS, FLAGS, KEYS, PROVENANCE

NORMALIZATION_VERSION = "1.0.0"
_SNIPPET = 120
_STEPS = {
    "strip_doi_suffix": "Remove the [doi] suffix",
    "extract_from_url": "Take the DOI out of a URL",
    "strip_prefix": "Remove the doi: prefix",
    "url_decode": "Decode percent escapes",
    "trim_punct": "Remove punctuation at the end",
    "casefold": "Fold case",
    "generate_canonical_url": "Make the resolver URL",
    "extract_digits": "Keep digits only",
    "extract_from_aid": "Take the number out of an article id",
    "normalize_title": "NFKC, fold case, strip accents, drop cosmetic punctuation, squeeze white space",
    "parse_author_names": "Split names into parts",
    "generate_author_signature": "Folded family name and initials",
    "generate_loose_signature": "Folded family name and first initial, sorted",
    "extract_year": "First four-digit year of the date",
    "normalize_journal": "NFKC, fold case, strip accents, squeeze white space",
    "normalize_pages": "One kind of dash, no blanks",
}


def _step(name: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(NORMALIZATION_VERSION).alias("version"), F.lit(_STEPS[name]).alias("notes"))


def _entry(field: str, present: Column, indices: Column, steps: Column, confidence: Column, fmt: Column, tags: Column) -> Column:
    """A provenance entry, or null where the field is absent."""
    source = lambda i: F.struct(
        F.concat(F.lit("raw.tags["), i.cast("string"), F.lit("]")).alias("path"),
        F.element_at(tags, i + 1)["tag"].alias("tag"),
        F.substring(F.element_at(tags, i + 1)["value_raw_joined"], 1, _SNIPPET).alias("value_snippet"),
        fmt.alias("source_format"),
    )
    value = F.struct(F.transform(indices, source).alias("sources"), steps.alias("transforms"), confidence.alias("confidence"))
    return F.when(present, F.struct(F.lit(f"canon.{field}").alias("key"), value.alias("value")))


def normalize(records: DataFrame) -> DataFrame:
    """``records`` (from the sources) with canon, keys, flags and provenance, all computed anew from raw.tags, so that it is idempotent.

    Null tags count as none. A format that isn't known is an error at run time.
    """
    c = F.col
    fmt, given = c("fmt__"), c("meta.source_format")
    names = {f: E.tag_names(f, fmt) for f in E.TAGS}
    df = records.withColumn("fmt__", E.known_format(given)).withColumn("hits__", E.numbered(F.coalesce(c("raw.tags"), F.array().cast(records.schema["raw"].dataType["tags"].dataType))))
    hits = c("hits__")
    pubmed = fmt == "nbib"
    candidate = lambda h: ~pubmed | F.lower(h["value"]).contains("[doi]") | h["value"].startswith("10.")
    picked = {f"{f}__": E.best(hits, names[f]) for f in ("pmid", "pmcid", "title", "journal_full", "journal_abbrev", "volume", "issue", "page_start", "page_end", "pages", "abstract", "language")}
    df = df.withColumns(
        picked
        | {
            "doi__": E.best(hits, names["doi"], candidate),
            "url__": E.earliest(hits, names["doi_url"], lambda h: E.doi_in_url(h["whole"]).isNotNull()),
            "aid_pmid__": E.earliest(hits, names["article_ids"], lambda h: h["whole"].rlike(r"(?i)[0-9]+\s*\[pmid]")),
            "aid_pmc__": E.earliest(hits, names["article_ids"], lambda h: h["whole"].rlike(r"(?i)PMC[0-9]+\s*\[pmc]")),
            "year__": E.earliest(hits, names["year"], lambda h: E.year(h["value"]).isNotNull()),
            "author_hits__": F.filter(E.every(hits, names["author"]), lambda h: F.lower(h["value"]) != "et al."),
            "types__": F.transform(E.every(hits, names["publication_type"]), lambda h: h["value"]),
        }
    )
    split = F.flatten(
        F.transform(c("author_hits__"), lambda h: F.transform(F.filter(F.split(h["value"], " and "), lambda p: (X.strip(p) != "") & (F.lower(X.strip(p)) != "et al.")), lambda p: F.struct(X.strip(p).alias("value"), h["idx"].alias("idx"))))
    )
    whole = F.transform(c("author_hits__"), lambda h: F.struct(h["value"].alias("value"), h["idx"].alias("idx")))
    df = df.withColumns(
        {
            "doi_raw__": F.coalesce(c("doi__.value"), E.doi_in_url(c("url__.whole"))),
            "doi_idx__": F.coalesce(c("doi__.idx"), c("url__.idx")),
            "doi_tag__": F.coalesce(c("doi__.tag"), c("url__.tag")),
            "pmid_digits__": X.or_null(F.regexp_replace(c("pmid__.value"), r"(?U)\D", "")),
            "authors__": F.when(fmt == "bibtex", split).otherwise(whole),
            "journal__": F.coalesce(c("journal_full__.value"), c("journal_abbrev__.value")),
            "span__": F.concat_ws("-", c("page_start__.value"), c("page_end__.value")),
        }
    )
    from_pages = X.or_null(c("span__")).isNull() & c("pages__.value").isNotNull()
    ranged = r"(?U)^(\p{Nd}+)\s*[—–-]\s*(\p{Nd}+)"
    df = df.withColumns(
        {
            "doi_norm__": E.doi(c("doi_raw__")),
            "pmid_norm__": F.coalesce(c("pmid_digits__"), X.or_null(F.regexp_extract(c("aid_pmid__.whole"), r"(?i)([0-9]+)\s*\[pmid]", 1))),
            "parsed__": F.transform(c("authors__"), lambda a: E.author(a["value"], fmt)),
            "title_norm__": X.for_matching(c("title__.value")),
            "abstract_norm__": X.light(c("abstract__.value")),
            "journal_norm__": F.regexp_replace(X.squeeze(X.fold(c("journal__"))), r"^[. ]+|[. ]+$", ""),
            "pages_raw__": F.coalesce(X.or_null(c("span__")), c("pages__.value")),
            "page_match__": F.when(from_pages, c("pages__.value").rlike(ranged)).otherwise(False),
            "from_pages__": from_pages,
        }
    )
    folded = F.split(X.fold_name(F.array_join(F.transform(c("parsed__"), lambda a: F.coalesce(a["family"], F.lit(""))), "\x1f")), "\x1f")
    df = df.withColumn("folded__", folded)
    signed = F.transform(
        c("parsed__"),
        lambda a, i: F.when((F.coalesce(a["family"], F.lit("")) != "") & (F.coalesce(a["initials"], F.lit("")) != ""), F.struct(F.get(c("folded__"), i).alias("family"), a["initials"].alias("initials"))),
    )
    elocator = F.coalesce(E.is_elocator(c("pages_raw__")), F.lit(False))
    unread = c("from_pages__") & ~c("page_match__") & ~c("pages__.value").rlike(r"(?U)^\d+$")
    df = df.withColumns({"signed__": signed, "elocator__": elocator, "unreliable__": F.coalesce(elocator | unread, F.lit(False))})
    strict = F.transform(F.filter(c("signed__"), lambda s: s.isNotNull()), lambda s: F.concat_ws("|", s["family"], s["initials"]))
    loose = F.array_sort(F.array_distinct(F.transform(F.filter(c("signed__"), lambda s: s.isNotNull()), lambda s: F.concat_ws("|", s["family"], F.substring(s["initials"], 1, 1)))))
    some = lambda array: F.when(F.size(array) > 0, array)
    first = F.get(c("signed__"), F.lit(0))
    page = lambda n: F.when(~c("elocator__"), F.coalesce(F.when(c("from_pages__"), F.when(c("page_match__"), F.regexp_extract(c("pages__.value"), ranged, n)).when(F.lit(n == 1) & c("pages__.value").rlike(r"(?U)^\d+$"), c("pages__.value"))), c(("page_start__.value", "page_end__.value")[n - 1])))
    canon = {
        "doi": c("doi_raw__"),
        "doi_norm": c("doi_norm__"),
        "doi_url": F.concat(F.lit("https://doi.org/"), c("doi_norm__")),
        "pmid": c("pmid__.value"),
        "pmid_norm": c("pmid_norm__"),
        "pmcid": F.coalesce(F.when(c("pmcid__.value").startswith("PMC"), c("pmcid__.value")).otherwise(F.concat(F.lit("PMC"), c("pmcid__.value"))), F.upper(X.or_null(F.regexp_extract(c("aid_pmc__.whole"), r"(?i)(PMC[0-9]+)\s*\[pmc]", 1)))),
        "title_raw": c("title__.value"),
        "title_norm_basic": c("title_norm__"),
        "abstract_raw": c("abstract__.value"),
        "abstract_norm_basic": c("abstract_norm__"),
        "authors_raw": some(F.transform(c("authors__"), lambda a: a["value"])),
        "authors_parsed": some(c("parsed__")),
        "first_author_sig": F.when(first.isNotNull(), F.concat_ws("|", first["family"], first["initials"])),
        "author_sig_strict": some(strict),
        "author_sig_loose": some(loose),
        "year_raw": c("year__.value"),
        "year_norm": E.year(c("year__.value")),
        "year_source": F.concat_ws(".", F.when(c("year__").isNotNull(), F.upper(given)), c("year__.tag")),
        "journal_full": c("journal_full__.value"),
        "journal_abbrev": c("journal_abbrev__.value"),
        "journal_norm": c("journal_norm__"),
        "volume": c("volume__.value"),
        "issue": c("issue__.value"),
        "pages_raw": c("pages_raw__"),
        "pages_norm_long": F.when(~c("unreliable__"), E.long_pages(c("pages_raw__"))),
        "page_first": page(1),
        "page_last": page(2),
        "article_number": F.when(c("elocator__"), c("pages_raw__")),
        "language": c("language__.value"),
        "publication_type": some(c("types__")),
    }
    canon["year_source"] = X.or_null(canon["year_source"])
    df = df.withColumn("canon", F.struct(*[canon[f].alias(f) for f in CANON_FIELDS]).cast(CANON))
    raw_doi = c("doi_raw__")
    doi_steps = F.filter(
        F.array(
            F.when(raw_doi.rlike(r"(?i)\[doi\]\s*$"), _step("strip_doi_suffix")),
            F.when(raw_doi.rlike("^https?://"), _step("extract_from_url")),
            F.when(raw_doi.rlike("(?i)^doi:"), _step("strip_prefix")),
            F.when(raw_doi.contains("%"), _step("url_decode")),
            F.when(raw_doi.rlike("[.,;]$"), _step("trim_punct")),
            _step("casefold"),
        ),
        lambda s: s.isNotNull(),
    )
    tags = c("raw.tags")
    one, sure = lambda idx: F.array(idx), F.lit("high")
    doi_sure = F.when(F.array_contains(F.slice(names["doi"], 1, 2), c("doi_tag__")), "high").otherwise("medium")
    author_idx = F.transform(c("authors__"), lambda a: a["idx"])
    with_pages = F.filter(F.when(c("from_pages__"), F.array(c("pages__.idx"))).otherwise(F.array(c("page_start__.idx"), c("page_end__.idx"))), lambda i: i.isNotNull())
    entry = lambda f, present, idx, steps, confidence=sure: _entry(f, present, idx, steps, confidence, given, tags)
    there = c("canon.doi_norm").isNotNull()
    entries = F.array(
        entry("doi_norm", there, one(c("doi_idx__")), doi_steps, doi_sure),
        entry("doi_url", there, one(c("doi_idx__")), F.concat(doi_steps, F.array(_step("generate_canonical_url"))), doi_sure),
        entry("pmid_norm", c("pmid_norm__").isNotNull(), one(F.when(c("pmid_digits__").isNotNull(), c("pmid__.idx")).otherwise(c("aid_pmid__.idx"))), F.when(c("pmid_digits__").isNotNull(), F.array(_step("extract_digits"))).otherwise(F.array(_step("extract_from_aid")))),
        entry("title_norm_basic", c("title__").isNotNull(), one(c("title__.idx")), F.array(_step("normalize_title"))),
        entry("authors_parsed", F.size(author_idx) > 0, author_idx, F.array(_step("parse_author_names"))),
        entry("first_author_sig", c("canon.first_author_sig").isNotNull(), F.slice(author_idx, 1, 1), F.array(_step("generate_author_signature"))),
        entry("author_sig_strict", c("canon.author_sig_strict").isNotNull(), author_idx, F.array(_step("generate_author_signature"))),
        entry("author_sig_loose", c("canon.author_sig_loose").isNotNull(), author_idx, F.array(_step("generate_loose_signature")), F.lit("medium")),
        entry("year_norm", c("canon.year_norm").isNotNull(), one(c("year__.idx")), F.array(_step("extract_year"))),
        entry("journal_norm", c("journal__").isNotNull(), one(F.coalesce(c("journal_full__.idx"), c("journal_abbrev__.idx"))), F.array(_step("normalize_journal"))),
        entry("pages_norm_long", (c("pages_raw__") != "") & (F.size(with_pages) > 0), with_pages, F.array(_step("normalize_pages")), F.when(c("unreliable__"), "medium").otherwise("high")),
    )
    canon_of = lambda f: c(f"canon.{f}")
    keys = K.matching_keys(canon_of("title_norm_basic"), canon_of("year_norm"), canon_of("first_author_sig"), canon_of("journal_norm"))
    flags = K.quality_flags(canon_of("doi_norm"), canon_of("pmid_norm"), canon_of("title_raw"), canon_of("authors_parsed"), canon_of("year_norm"), c("unreliable__"), canon_of("publication_type"))
    return df.select(
        *[records[x] for x in ("schema_version", "rid", "record_digest", "source_digest", "meta", "raw")],
        "canon",
        keys.cast(KEYS).alias("keys"),
        flags.cast(FLAGS).alias("flags"),
        F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).cast(PROVENANCE).alias("provenance"),
    )
