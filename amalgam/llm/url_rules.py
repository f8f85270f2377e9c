"""URL filtering by association rules: FP-growth over tokens of labelled URLs, pruned rules, matched by an inverted index."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.session import BROADCAST_IDS, cut

#: Least part of labelled URLs, and least number of them, that a rule's tokens occur in together with the label; least confidence.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 5, 0.4
#: A page is blocked where its best rule is right more often than wrong.
BLOCK_ABOVE = 0.5
#: The item that stands for a low-quality label; it can't be a URL token, which all have a letter and a colon first.
LOW = "#low"


def url_tokens(url: Column) -> Column:
    """Distinct tokens in order: scheme (s:), host labels (h:), path segments with digits as # (p:), parameters (q:) and fragment (f:)."""
    low = F.lower(F.trim(url))

    def parts(prefix: str, pieces: Column) -> Column:
        return F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    host = F.regexp_extract(low, "^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(low, "^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1), "[0-9]+", "#")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                parts("s:", F.array(F.regexp_extract(low, "^([a-z][a-z0-9+.-]*)://", 1))),
                parts("h:", F.split(host, r"\.")),
                parts("p:", F.split(path, "/")),
                parts("q:", F.split(F.regexp_extract(low, r"^[^?#]*\?([^#]*)", 1), "&")),
                parts("f:", F.array(F.regexp_extract(low, "#(.*)$", 1))),
            )
        )
    )


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id (its tokens, joined by " & "), tokens, rarest (its token in the fewest labelled URLs), n_urls (with the tokens), n_low (also with the label)
    and confidence, from (tokens, low).

    Kept are rules with enough support and confidence of which no part is a rule that is at least as confident. Null and empty tokens make no rule.
    """
    items = cut(labelled.select(F.when(F.col("low"), F.array_append("tokens", F.lit(LOW))).otherwise(F.col("tokens")).alias("items")).filter("size(items) > 0"))
    n = items.count()
    schema = "rule_id string, tokens array<string>, rarest string, n_urls bigint, n_low bigint, confidence double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    sets = cut(FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n))).fit(items).freqItemsets)
    counted = sets.filter(~F.array_contains("items", LOW)).select(F.array_join(F.array_sort("items"), " & ").alias("rule_id"), F.col("freq").alias("n_urls"))
    hits = sets.filter(F.array_contains("items", LOW) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", LOW)).alias("tokens"), F.col("freq").alias("n_low"))
    confident = (
        hits.withColumn("rule_id", F.array_join("tokens", " & "))
        .join(counted, "rule_id")
        .withColumn("confidence", F.col("n_low") / F.col("n_urls"))
        .filter(F.col("confidence") >= min_confidence)
    )
    alone = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("n_token"))
    rarest = confident.select("rule_id", F.explode("tokens").alias("token")).join(alone, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n_token", "token")).alias("rarest"))
    rules = cut(confident.join(rarest, "rule_id"))
    parts = match_rules(rules.select(F.col("rule_id").alias("key"), "tokens"), rules)
    whole = rules.select(F.col("rule_id").alias("key"), F.col("confidence").alias("own"))
    beaten = parts.filter("key <> rule_id").join(whole, "key").filter("confidence >= own").select(F.col("key").alias("rule_id")).distinct()
    return cut(rules.join(beaten, "rule_id", "left_anti").select("rule_id", "tokens", "rarest", "n_urls", "n_low", "confidence"))


def match_rules(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule_id and confidence of the rules all of whose tokens a key has; keys and their tokens are distinct.

    An inverted index: each rule is listed under its rarest token only, so that tokens of nearly all URLs list hardly any. The index is broadcast if it
    has few enough rules; else it is joined by a shuffle. Keys without tokens match nothing; without rules nothing matches.
    """
    index = rules.select("rule_id", "confidence", F.col("tokens").alias("needed"), F.col("rarest").alias("token"))
    index = F.broadcast(index) if index.count() * 8 <= BROADCAST_IDS else index.hint("merge")
    found = keyed.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return found.filter(F.size(F.array_except("needed", "tokens")) == 0).select("key", "rule_id", "confidence")


def filter_urls(pages: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """page_id, url, n_rules, best_rule, confidence and blocked (whether the best rule is right for more than half of its labelled pages), one row for each page.

    Rules are mined from the pages that ``labels`` (doc_id is the page_id, quality 0 or 1) covers; a page with labels of both kinds counts as low.

    * Null or empty URL, or one without a token: no rule, not blocked. Null page_id: matched like any, but not labelled. Repeated rows: one row each.
    * Whole URLs at any length. The best rule is the most confident one; of equals the first in order. Without labels there are no rules.
    * Only the named columns are used, so further columns don't matter.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    low = labels.select(F.col("doc_id").cast("bigint").alias("page_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").groupBy("page_id").agg((F.min("quality") == 0).alias("low"))
    labelled = pages.filter("url is not null").distinct().join(low, "page_id").select(url_tokens(F.col("url")).alias("tokens"), "low")
    rules = mine_rules(labelled, **parameters)
    urls = pages.filter("url is not null").select("url").distinct()
    best = Window.partitionBy("key").orderBy(F.desc("confidence"), "rule_id")
    matched = (
        match_rules(urls.select(F.col("url").alias("key"), url_tokens(F.col("url")).alias("tokens")), rules)
        .withColumns({"rank": F.row_number().over(best), "n_rules": F.count(F.lit(1)).over(Window.partitionBy("key"))})
        .filter("rank = 1")
        .select(F.col("key").alias("url"), "n_rules", F.col("rule_id").alias("best_rule"), F.round("confidence", 6).alias("confidence"), (F.col("confidence") > BLOCK_ABOVE).alias("blocked"))
    )
    return pages.join(matched, "url", "left").select("page_id", "url", F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"), "best_rule", "confidence", F.coalesce("blocked", F.lit(False)).alias("blocked"))
