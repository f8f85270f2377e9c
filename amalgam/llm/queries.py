"""The operators over the whole tables, and SQL with the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from amalgam.llm import cminhash, flow_mix, itq, langid, packing, prefix_hash, suffix_tree, toxicity, url_rules, warc_merge
from amalgam.session import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture histories of all pages."""
    return warc_merge.merge_captures(warc_merge.page_captures(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


OP1_SQL = r"""
WITH a AS (SELECT page_id, md5(html) AS digest, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS bare FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
 list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS asked FROM a),
c AS (SELECT page_id, digest, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(37 * page_id) AS captured_at,
 array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
 || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS url_key FROM b WHERE bare IS NOT NULL)
SELECT row_number() OVER (ORDER BY url_key, captured_at, page_id, digest) AS global_rank, url_key, captured_at, page_id,
 CAST(row_number() OVER h AS INTEGER) AS capture_no, count(*) OVER (PARTITION BY url_key) AS n_captures, lag(captured_at) OVER h AS previous_at,
 row_number() OVER h = 1 OR digest IS DISTINCT FROM lag(digest) OVER h AS changed
FROM c WINDOW h AS (PARTITION BY url_key ORDER BY captured_at, page_id, digest)
"""


def op2_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents."""
    return suffix_tree.repeated_passages(_documents(spark, sf_dir))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM s),
n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM h),
f AS (SELECT doc_id, 'repeat' AS kind, pos FROM n WHERE n > 1 UNION ALL SELECT doc_id, 'cut', pos FROM n WHERE k > 1),
i AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, kind ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM f),
j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS island FROM i)
SELECT doc_id, kind, min(pos) AS word_start, max(pos) + 50 AS word_end, max(pos) + 50 - min(pos) AS n_words FROM j GROUP BY doc_id, kind, island
"""


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with the rule that blocks them, by rules mined from the labelled ones."""
    return url_rules.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of all documents that have a language."""
    docs = _documents(spark, sf_dir)
    return langid.identify_languages(docs, langid.train_profiles(docs))


def op5_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for the default weights, from all documents."""
    return flow_mix.mix(_documents(spark, sf_dir))


def op6_itq_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every embedding."""
    return itq.near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = r"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.9),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, u.b FROM r JOIN u ON r.other = u.a),
g AS (SELECT vec_id, min(other) AS group_id FROM r GROUP BY vec_id)
SELECT vec_id, group_id, group_id = vec_id AS keep FROM g
"""


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, copies and common extensions of all documents."""
    return prefix_hash.fingerprint_documents(_documents(spark, sf_dir))


OP7_SQL = r"""
WITH c AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?s).'), lambda x: unicode(x)) AS points FROM documents),
h AS (SELECT doc_id, text, len(points) AS n_chars, CAST(list_reduce(list_reverse(points), lambda a, x: (a * 2251055966835893287 + x + 1) % 2305843009213693951, CAST(0 AS HUGEINT)) AS BIGINT) AS fingerprint, points FROM c),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS copy_of FROM h),
d AS (SELECT doc_id, points, min(doc_id) OVER (PARTITION BY points[:32]) AS anchor_id FROM f WHERE doc_id = copy_of AND n_chars >= 32),
p AS (SELECT d.doc_id, d.anchor_id, d.points AS x, o.points AS y FROM d JOIN d o ON d.anchor_id = o.doc_id WHERE d.doc_id <> d.anchor_id),
l AS (SELECT doc_id, anchor_id, least(len(x), len(y)) AS most, list_position(list_transform(list_zip(x, y, true), lambda z: z[1] = z[2]), false) AS ahead,
 list_position(list_transform(list_zip(list_reverse(x), list_reverse(y), true), lambda z: z[1] = z[2]), false) AS behind FROM p),
m AS (SELECT doc_id, anchor_id, most, coalesce(ahead - 1, most) AS common_prefix, coalesce(behind - 1, most) AS suffix FROM l)
SELECT f.doc_id, n_chars, fingerprint, copy_of, anchor_id, common_prefix, least(suffix, most - common_prefix) AS common_suffix FROM f LEFT JOIN m USING (doc_id)
"""


def op7_longest_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prefix and suffix that each document has in common with any other."""
    return prefix_hash.longest_extensions(_documents(spark, sf_dir))


def op8_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return packing.pack_documents(_documents(spark, sf_dir))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return cminhash.near_duplicate_groups(_documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE shared >= 0.5 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a),
g AS (SELECT doc_id, min(other) AS group_id FROM r GROUP BY doc_id)
SELECT doc_id, group_id, group_id = doc_id AS keep FROM g
"""


def op10_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network fitted on labelled ones."""
    docs = _documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_suffix_tree_repeats": op2_suffix_tree_repeats,
    "op3_url_rules": op3_url_rules,
    "op4_hyperdimensional_langid": op4_hyperdimensional_langid,
    "op5_flow_mix": op5_flow_mix,
    "op6_itq_near_embeddings": op6_itq_near_embeddings,
    "op7_prefix_fingerprints": op7_prefix_fingerprints,
    "op8_ffd_packing": op8_ffd_packing,
    "op9_circulant_minhash": op9_circulant_minhash,
    "op10_bigru_toxicity": op10_bigru_toxicity,
}

#: Queries besides the one of each number.
FURTHER: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_longest_extensions": op7_longest_extensions}

ORACLES: dict[str, str] = {
    "op1_warc_index_merge": OP1_SQL,
    "op2_suffix_tree_repeats": OP2_SQL,
    "op6_itq_near_embeddings": OP6_SQL,
    "op7_prefix_fingerprints": OP7_SQL,
    "op9_circulant_minhash": OP9_SQL,
}
