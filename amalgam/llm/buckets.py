"""Groups of near duplicates from candidate buckets: exact over all pairs that share a bucket, without listing pairs inside a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.operators.components import connected_components
from amalgam.session import cut


def near_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(node, component)`` of the graph whose edges are the pairs that share a bucket and pass ``verify``.

    ``members``: (id, key), with further column ``code`` if ``near`` is given; no repeats. ``verify`` takes pairs (a, b) with a < b and returns those that pass.
    ``near`` is a cheap test on two codes that every pair has to pass before ``verify``.

    First each bucket's members are compared with its least member, and components are made of the pairs that pass. A pair inside a
    component can't change the result any more, so only pairs of one bucket with different components are compared then: all of them.

    * Least members and sizes are aggregated before the shuffle, and all else are equi-joins, whose crowded keys AQE splits; no bucket is collected.
    * Null ids or keys join nothing. No members, or none that share a bucket: an empty result. Further columns are not read.
    """
    code = ["code"] if near else []
    buckets = members.groupBy("key").agg(F.min(F.struct("id", *code)).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    sized = cut(members.select("id", "key", *code).join(buckets, "key"))
    star = sized.filter("id <> least.id")
    if near:
        star = star.filter(near(F.col("least.code"), F.col("code")))
    star = cut(star.select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct())
    passed = cut(verify(star))
    first = cut(connected_components(passed, "a", "b"))
    tagged = sized.select("key", F.struct("id", *code).alias("x")).join(first.select(F.col("node").alias("id"), "component"), F.col("x.id") == F.col("id"), "left").select("key", "x", F.coalesce("component", "x.id").alias("label"))
    labels = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    mixed = cut(tagged.join(labels, "key", "left_semi"))
    of_bucket = mixed.select("key", "label").distinct()
    crossed = of_bucket.withColumnRenamed("label", "la").join(of_bucket.withColumnRenamed("label", "lb"), "key").filter("la < lb")
    crossed = crossed.join(mixed.select("key", F.col("label").alias("la"), F.col("x").alias("p")), ["key", "la"]).join(mixed.select("key", F.col("label").alias("lb"), F.col("x").alias("q")), ["key", "lb"])
    if near:
        crossed = crossed.filter(near(F.col("p.code"), F.col("q.code")))
    crossed = crossed.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    rest = cut(crossed.join(star, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return first
    late = cut(verify(rest))
    return first if late.isEmpty() else cut(connected_components(passed.union(late), "a", "b"))
