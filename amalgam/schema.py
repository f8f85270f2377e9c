"""Types of records, pairs, decisions, clusters and merged records; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

FORMATS = ("ris", "pubmed", "nbib", "wos", "bibtex", "endnote_tagged")

_TAG = "struct<tag:string,value_lines:array<string>,value_raw_joined:string,occurrence:int,line_start:int,line_end:int>"
RAW = f"struct<record_lines:array<string>,tags:array<{_TAG}>,unknown_lines:array<string>>"
META = (
    "struct<source_file:string,source_format:string,source_db:string,source_record_index:int,ingested_at:string,"
    "source_file_mtime:string,source_file_size_bytes:bigint,parser_version:string>"
)
AUTHOR = "struct<family:string,given:string,initials:string,suffix:string,raw:string>"
#: Canonical fields in order, with their types.
CANON_FIELDS: dict[str, str] = {
    **dict.fromkeys("doi doi_norm doi_url pmid pmid_norm pmcid title_raw title_norm_basic abstract_raw abstract_norm_basic".split(), "string"),
    "authors_raw": "array<string>",
    "authors_parsed": f"array<{AUTHOR}>",
    "first_author_sig": "string",
    "author_sig_strict": "array<string>",
    "author_sig_loose": "array<string>",
    "year_raw": "string",
    "year_norm": "int",
    **dict.fromkeys("year_source journal_full journal_abbrev journal_norm volume issue pages_raw pages_norm_long page_first page_last article_number language".split(), "string"),
    "publication_type": "array<string>",
}
CANON = "struct<" + ",".join(f"{k}:{v}" for k, v in CANON_FIELDS.items()) + ">"
KEY_FIELDS: dict[str, str] = {
    **dict.fromkeys(("title_key_strict", "title_year_key", "title_first_author_key", "title_journal_key", "title_key_fuzzy"), "string"),
    "title_shingles": "array<string>",
    "title_minhash": "string",
    "title_simhash": "string",
}
KEYS = "struct<" + ",".join(f"{k}:{v}" for k, v in KEY_FIELDS.items()) + ">"
FLAG_FIELDS = (
    "doi_present", "pmid_present", "title_missing", "title_truncated", "authors_missing", "authors_incomplete", "year_missing",
    "pages_unreliable", "is_erratum_notice", "is_retraction_notice", "is_corrected_republished", "has_linked_citation",
)
FLAGS = "struct<" + ",".join(f"{k}:boolean" for k in FLAG_FIELDS) + ">"
PROVENANCE = "map<string,struct<sources:array<struct<path:string,tag:string,value_snippet:string,source_format:string>>,transforms:array<struct<name:string,version:string,notes:string>>,confidence:string>>"

#: What a parser yields.
PARSED = f"schema_version string, rid string, record_digest string, source_digest string, meta {META}, raw {RAW}"
RECORD = f"{PARSED}, canon {CANON}, keys {KEYS}, flags {FLAGS}, provenance {PROVENANCE}"

PAIRS = "pair_id string, rid_a string, rid_b string, sources array<struct<blocker:string,block_key:string,match_key:string>>"
CALIBRATION = "pair_id string, p_match double, is_duplicate boolean"
DECISIONS = "pair_id string, rid_a string, rid_b string, p_match double, decision string, reasons array<struct<code:string>>, warnings array<string>"

_LEVEL = "struct<level:string,sim:double,weight:double>"
SCORES = (
    "pair_id string, rid_a string, rid_b string, candidate_sources array<struct<blocker:string,block_key:string,match_key:string>>, "
    f"comparison struct<{','.join(f'{f}:{_LEVEL}' for f in ('doi', 'pmid', 'title', 'authors', 'year', 'journal', 'pages'))}>, llr double, p_match double, "
    "explain struct<top_contributions:array<struct<field:string,level:string,weight:double>>>, warnings array<string>, model struct<name:string,version:string>"
)
CLUSTERS = (
    "cluster_id string, status string, rids array<string>, support struct<edges_auto_dup:int,strong_edge_count:int,sources:map<string,int>>, "
    "consistency struct<hard_conflicts:array<string>,soft_conflicts:array<string>,notes:array<string>>"
)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
