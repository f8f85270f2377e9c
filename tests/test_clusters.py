import random

import pytest

from amalgam.operators import cluster, merge
from amalgam.operators.components import connected_components
from tests import samples

DECISION = "pair_id string, rid_a string, rid_b string, p_match double, decision string, reasons array<struct<code:string>>"


def brute_components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == brute_components(edges)


def test_components_of_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    rows = spark.createDataFrame([("a", None), ("b", "a")], "src string, dst string")
    assert {tuple(r) for r in connected_components(rows).collect()} == {("a", "a"), ("b", "a")}


def world(spark, records, edges):
    df = samples.normalized(spark, samples.ris(*records)).cache()
    rid = [r["rid"] for r in df.collect()]
    rows = [("|".join(sorted((rid[a], rid[b]))), *sorted((rid[a], rid[b])), p, kind, [("p_above_t_high",)]) for a, b, p, kind in edges]
    return df, rid, spark.createDataFrame(rows, DECISION)


def test_cluster_states(spark):
    same = {"TI": "One title", "PY": "2000"}
    records = [
        same | {"AU": "A, B"}, same | {"AU": "C, D"},  # fine
        same | {"PY": "1990"}, same | {"PY": "2010"},  # years apart
        same | {"KW": "x"}, {"TI": "Other title", "PY": "2000"}, # titles differ
        same | {"KW": "1"}, same | {"KW": "2"}, same | {"KW": "3"},  # weak chain
        same | {"KW": "4"}, same | {"KW": "5"}, same | {"KW": "6"},  # kept apart inside
    ]
    dup = lambda a, b, p=0.9995: (a, b, p, "AUTO_DUP")
    edges = [dup(0, 1, 0.96), dup(2, 3), dup(4, 5), dup(6, 7), dup(7, 8, 0.96), dup(9, 10), dup(10, 11), (9, 11, 0.1, "AUTO_KEEP")]
    df, rid, decisions = world(spark, records, edges)
    found = {frozenset(rid.index(x) for x in r["rids"]): r for r in cluster.build_clusters(decisions, df).collect()}
    conflicts = {k: (r["consistency"]["hard_conflicts"], r["consistency"]["soft_conflicts"]) for k, r in found.items()}
    assert conflicts == {
        frozenset({0, 1}): ([], []), frozenset({2, 3}): ([], ["year_far"]), frozenset({4, 5}): ([], ["title_key_divergent"]), frozenset({6, 7, 8}): ([], ["bridged_by_weak_edges"]),
        frozenset({9, 10, 11}): (["internal_auto_keep_contradiction"], []),
    }
    good = found[frozenset({0, 1})]
    assert good["status"] == "AUTO" and good["support"]["edges_auto_dup"] == 1 and good["support"]["strong_edge_count"] == 0 and good["support"]["sources"] == {"p_above_t_high": 1}
    summary = merge.merge_summary(df, cluster.build_clusters(decisions, df)).first()
    assert summary["records_in_total"] == len(records) and summary["clusters_auto_in"] == 1 and summary["records_out_review_pending"] == 10 and summary["singletons_count"] == 0


def test_two_pmcids_are_for_review(spark):
    from pyspark.sql import functions as F

    df, _, decisions = world(spark, [{"TI": "x", "PY": "2000", "KW": str(i)} for i in range(2)], [(0, 1, 0.9999, "AUTO_DUP")])
    df = df.withColumn("canon", F.col("canon").withField("pmcid", F.concat(F.lit("PMC"), "rid")))
    (row,) = cluster.build_clusters(decisions, df).collect()
    assert row["status"] == "REVIEW" and row["consistency"]["hard_conflicts"] == ["pmcid_conflict"]


def test_split_by_doi_pools_records_without(spark):
    same = {"TI": "One title", "PY": "2000"}
    records = [same | {"DO": "10.1/a", "KW": "1"}, same | {"DO": "10.1/a", "KW": "2"}, same | {"DO": "10.1/b"}, same | {"KW": "3"}, same | {"KW": "4"}]
    df, rid, decisions = world(spark, records, [(i, i + 1, 0.9999, "AUTO_DUP") for i in range(4)])
    found = {frozenset(rid.index(x) for x in r["rids"]): r for r in cluster.build_clusters(decisions, df).collect()}
    assert set(found) == {frozenset({0, 1}), frozenset({2}), frozenset({3, 4})}
    assert all(r["status"] == "AUTO" for r in found.values()) and found[frozenset({2})]["support"]["edges_auto_dup"] == 0
    whole = cluster.build_clusters(decisions, df, cluster.ClusterConfig(split_by_id=False)).collect()
    assert len(whole) == 1 and whole[0]["consistency"]["hard_conflicts"] == ["doi_conflict"]


def test_large_cluster_is_only_noted(spark):
    records = [{"TI": "Same", "PY": "2000", "KW": str(i)} for i in range(27)]
    df, _, decisions = world(spark, records, [(0, i, 0.9999, "AUTO_DUP") for i in range(1, 27)])
    (row,) = cluster.build_clusters(decisions, df).collect()
    assert row["status"] == "AUTO" and row["consistency"]["notes"] == ["oversized_cluster_size_27_exceeds_25"]


def test_no_decisions(spark):
    df, _, decisions = world(spark, [{"TI": "x"}], [])
    assert cluster.build_clusters(decisions, df).count() == 0 and merge.singletons(df, cluster.build_clusters(decisions, df)).count() == 1


def test_merge_rules(spark):
    records = [
        {"TI": "Short", "PY": "2019", "AU": ["A, B"], "LA": "en", "JF": "Jour", "SP": "1", "EP": "9", "VL": "4"},
        {"TI": "Short!", "PY": "2020", "AU": ["A, B", "C, D"], "LA": "de", "AB": "text", "DO": "10.1/a", "SP": "e5"},
        {"TI": "Short", "PY": "2020", "LA": "en", "JF": "Journal"},
    ]
    df, rid, decisions = world(spark, records, [(0, 1, 0.9999, "AUTO_DUP"), (1, 2, 0.9999, "AUTO_DUP")])
    clusters = cluster.build_clusters(decisions, df)
    (row,) = merge.merge_clusters(clusters, df).collect()
    c = row["canon"]
    assert row["survivor_rid"] == rid[1] and row["member_rids"] == sorted(rid) and row["merged_id"][2:] == row["cluster_id"][2:]
    assert (c["title_raw"], c["year_norm"], c["year_source"], c["doi"], c["journal_full"]) == ("Short!", 2020, "merge:mode", "10.1/a", "Journal")
    assert len(c["authors_parsed"]) == 2 and c["language"] == ["de", "en"] and (c["page_first"], c["volume"]) == ("1", "4")
    p = row["merge_provenance"]
    assert p["title_raw"]["from_rid"] == [rid[1]] and p["language"]["rule"] == "union_distinct_sorted" and p["pmid_norm"]["rule"] == "no_value_in_cluster"
    shuffled = merge.merge_clusters(clusters, df.repartition(3)).collect()
    assert shuffled == [row]


@pytest.mark.parametrize(("years", "survivor", "want"), [([2019, 2020, 2020], 2019, 2020), ([2019, 2020], 2020, 2020), ([2019, 2020], None, 2019), ([], None, None)])
def test_year_mode(spark, years, survivor, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(years, survivor)], "y array<int>, s int")
    assert df.select(merge.mode_or(F.col("y"), F.col("s")).alias("x")).first()["x"] == want
