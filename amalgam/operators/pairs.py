"""Scoring of candidate pairs: two joins to slim records, then one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import ids
from amalgam.functions import score as S
from amalgam.functions.compare import COMPARATORS, FieldComparator
from amalgam.session import latest_by

#: What a comparison reads; raw tags, abstracts and provenance stay out of the joins.
_USED = ("canon.doi_norm", "canon.pmid_norm", "canon.pmcid", "canon.title_norm_basic", "canon.first_author_sig", "canon.author_sig_strict", "canon.year_norm", "canon.journal_norm", "canon.pages_norm_long", "canon.page_first", "canon.article_number")
_KEYS = ("keys.title_shingles", "keys.title_key_strict")
_FLAGS = ("title_truncated", "pages_unreliable", "is_erratum_notice", "is_retraction_notice", "is_corrected_republished", "has_linked_citation")


def slim(records: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row for each rid with what comparing and deciding needs, and the fields of paths ``more``; of repeated rids the one with the highest index in its file."""
    used = sorted({*_USED, *_KEYS, *(f"flags.{f}" for f in _FLAGS), *more})
    canon, keys, flags = (F.struct(*[F.col(p).alias(p.split(".")[1]) for p in used if p.startswith(part)]) for part in ("canon.", "keys.", "flags."))
    rows = records.filter("rid is not null").select("rid", F.struct(canon.alias("canon"), keys.alias("keys"), flags.alias("flags")).alias("record"), F.col("meta.source_record_index").alias("index"))
    return latest_by(rows, "rid", "index").select("rid", "record")


def with_records(pairs: DataFrame, slims: DataFrame, how: str = "inner") -> DataFrame:
    """``pairs`` with columns a and b: the records of both."""
    a = slims.select(F.col("rid").alias("rid_a"), F.col("record").alias("a"))
    b = slims.select(F.col("rid").alias("rid_b"), F.col("record").alias("b"))
    return pairs.join(a, "rid_a", how).join(b, "rid_b", how)


def with_scores(joined: DataFrame, model: S.Model, comparators: Sequence[FieldComparator] = COMPARATORS) -> DataFrame:
    """``joined`` (with columns a and b) with comparison, llr, p_match, top_contributions and warnings.

    Similarities, levels, weights and the sum are projected one after the other, so that none is computed twice.
    """
    compared = {f.name: f.compare(lambda p: F.col(f"a.{p}"), lambda p: F.col(f"b.{p}")) for f in comparators}
    level, weight = (lambda f: F.col(f"level_{f}__")), (lambda f: F.col(f"weight_{f}__"))
    sim = lambda f: F.col(f"sim_{f}__")
    df = joined.withColumns({f"sim_{f}__": c.sim for f, c in compared.items()})
    df = df.withColumns({f"level_{f}__": c.level_of(sim(f)) for f, c in compared.items()})
    df = df.withColumns({f"weight_{f}__": model.weight(f, level(f)) for f in compared})
    df = df.withColumn("raw_llr__", model.llr([weight(f) for f in compared]))
    fields = [F.struct(level(f).alias("level"), model.round(sim(f)).alias("sim"), model.round(weight(f)).alias("weight")).alias(f) for f in compared]
    return df.withColumns(
        {
            "comparison": F.struct(*fields),
            "llr": model.round(F.col("raw_llr__")),
            "p_match": model.round(S.sigmoid(F.col("raw_llr__"))),
            "top_contributions": S.top_contributions([(f, level(f), weight(f)) for f in compared]),
            "warnings": F.array_distinct(F.concat(*[c.warnings for c in compared.values()])),
        }
    )


def score_pairs(pairs: DataFrame, records: DataFrame, model: S.Model | None = None, comparators: Sequence[FieldComparator] = COMPARATORS) -> DataFrame:
    """pair_id, rid_a, rid_b, candidate_sources, comparison (level, sim and weight of each field), llr, p_match, explain (top_contributions), warnings and model.

    Pairs of which a record isn't there are left out; ``missing_pairs`` gives them. ``comparators`` of one's own read the fields that they name in
    ``uses`` besides the usual ones; the model has to have weights for all of their levels.
    """
    model = model or S.Model()
    named = F.struct(F.lit(model.name).alias("name"), F.lit(model.version).alias("version"))
    more = [path for f in comparators for path in f.uses]
    scored = with_scores(with_records(pairs, slim(records, more)), model, comparators)
    return scored.select(
        ids.pair_id(F.col("rid_a"), F.col("rid_b")).alias("pair_id"), "rid_a", "rid_b", F.col("sources").alias("candidate_sources"), "comparison", "llr", "p_match", F.struct("top_contributions").alias("explain"), "warnings", named.alias("model")
    )


def missing_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with a record that isn't there."""
    known = records.select("rid").distinct()
    joined = pairs.join(known.select(F.col("rid").alias("rid_a"), F.lit(True).alias("has_a")), "rid_a", "left").join(known.select(F.col("rid").alias("rid_b"), F.lit(True).alias("has_b")), "rid_b", "left")
    return joined.filter("has_a is null or has_b is null").select(*pairs.columns)


def score_statistics(scores: DataFrame, weight: Column | None = None) -> DataFrame:
    """bucket and n_pairs, all ten buckets; a row of ``scores`` counts as ``weight`` pairs, or as one."""
    counts = scores.groupBy(S.bucket(F.col("p_match")).alias("bucket")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    labels = scores.sparkSession.createDataFrame([(label,) for label, _ in S.BUCKETS], "bucket string")
    return labels.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n_pairs"))


def warning_counts(scores: DataFrame) -> DataFrame:
    """One row: pairs with each warning."""
    names = ("title_truncated", "pages_unreliable", "both_present_id_conflicts")
    return scores.agg(*[F.count_if(F.array_contains("warnings", w)).alias(w if w.endswith("conflicts") else f"{w}_pairs") for w in names])
