import math

import pytest
from pyspark.sql import functions as F

from amalgam.functions import compare as C
from amalgam.functions import score as S
from amalgam.operators import blocking as B
from amalgam.operators import calibrate, decide, pairs
from amalgam.session import spread
from tests import samples

RECORDS = [
    {"TI": "A study of long things in water", "AU": "Smith, John", "PY": "2019", "DO": "10.1/a", "JF": "J"},
    {"TI": "A study of long things in water", "AU": "Smith, John", "PY": "2020", "DO": "10.1/a", "JF": "J"},
    {"TI": "A study of long things in water", "AU": "Smith, John", "PY": "2021", "JF": "K"},
    {"TI": "Something else", "PY": "1999", "DO": "10.1/b"},
    {"TI": ""},
]


@pytest.fixture(scope="module")
def records(spark):
    return samples.normalized(spark, samples.ris(*RECORDS)).cache()


def place(records, df):
    at = {r["rid"]: r["meta"]["source_record_index"] for r in records.collect()}
    return {tuple(sorted((at[r["rid_a"]], at[r["rid_b"]]))): r for r in df.collect()}


@pytest.mark.parametrize(("name", "want"), [("doi", {(0, 1)}), ("pmid", set()), ("year_title", {(0, 1), (0, 2), (1, 2)}), ("year_author", {(0, 1), (0, 2), (1, 2)}), ("minhash", {(0, 1), (0, 2), (1, 2)}), ("simhash", {(0, 1), (0, 2), (1, 2)}), ("rare_tokens", set())])
def test_blockers(spark, records, name, want):
    blocker = B.create_blocker(B.BlockerConfig(name))
    found = place(records, B.generate_candidates(records, [blocker]))
    assert set(found) == want
    for row in found.values():
        assert row["rid_a"] < row["rid_b"] and [s["blocker"] for s in row["sources"]] == [blocker.name]


def test_sources_are_united_by_name_with_the_least_key(records):
    found = place(records, B.generate_candidates(records, [B.YearTitleBlocker(), B.DoiBlocker()]))
    assert [s["blocker"] for s in found[0, 1]["sources"]] == ["bib_year_pm1_title_prefix_v1", "doi_exact"]
    assert found[0, 1]["sources"][0]["block_key"].startswith("y2019:tpa study of long")
    assert B.generate_candidates(records, []).count() == 0


def test_unknown_and_disabled_blockers():
    with pytest.raises(ValueError, match="unknown blocker"):
        B.create_blocker(B.BlockerConfig("nope"))
    assert B.create_blockers([B.BlockerConfig("doi", enabled=False)]) == []


def test_rare_tokens(spark):
    rows = [(f"r{i}", ["common", f"own{i}", "pair" if i < 2 else "other"]) for i in range(200)]
    found = {r["rid"]: r["token"] for r in B.rare_tokens(spark.createDataFrame(rows, "rid string, tokens array<string>"), k=1).collect()}
    assert found["r0"] == "own0" and len(found) == 200
    two = B.rare_tokens(spark.createDataFrame(rows, "rid string, tokens array<string>"), k=2).filter("token = 'pair'").count()
    assert two == 2


def test_statistics(spark):
    keys = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k"), ("c", "l")], "rid string, block_key string")
    row = B.block_statistics(keys, keys.select("rid").distinct()).first()
    assert (row["records_seen"], row["records_keyed"], row["unique_keys"], row["blocks_gt1"], row["pairs_raw"], row["max_block"]) == (3, 3, 2, 1, 3, 3)


LEVELS = {"doi": "missing", "pmid": "missing", "title": "missing", "authors": "missing", "year": "missing", "journal": "missing", "pages": "missing"}


@pytest.mark.parametrize(
    ("levels", "llr", "p"),
    [
        ({}, -4.59512, 0.01),
        ({"doi": "exact"}, 2.31158, 0.909832),
        ({"title": "exact", "year": "exact"}, 5.14868, 0.994226),
        ({"year": "exact", "title": "exact", "authors": "strong"}, 7.98188, 0.999659),
        ({"doi": "both_present_mismatch", "title": "exact"}, -2.34692, 0.087311),
        ({"year": "exact", "journal": "low", "authors": "mismatch"}, -3.90192, 0.019803),
    ],
)
def test_scores(spark, levels, llr, p):
    model = S.Model()
    total = model.llr([model.weight(f, F.lit(v)) for f, v in (LEVELS | levels).items()])
    row = spark.range(1).select(model.round(total).alias("llr"), model.round(S.sigmoid(total)).alias("p")).first()
    assert (row["llr"], row["p"]) == (llr, p)


def test_unknown_level_fails(spark):
    with pytest.raises(Exception, match="no weight"):
        spark.range(1).select(S.Model().weight("doi", F.lit("odd"))).collect()
    with pytest.raises(ValueError):
        S.logit(1.0)


def test_bucket_ends_and_sigmoid(spark):
    rows = spark.createDataFrame([(0.0, "0.0-0.1"), (0.1, "0.1-0.2"), (0.3, "0.3-0.4"), (0.9, "0.9-1.0"), (1.0, "0.9-1.0")], "p double, want string")
    assert rows.filter(S.bucket(F.col("p")) != F.col("want")).count() == 0
    assert spark.range(1).select(S.sigmoid(F.lit(-1000.0)).alias("x"), S.sigmoid(F.lit(1000.0)).alias("y")).first() == (0.0, 1.0)


def test_jaccard_of_empty_sets(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(C.jaccard(arr(), arr()).alias("a"), C.jaccard(arr("x"), arr()).alias("b"), C.jaccard(arr("x", "x", "y"), arr("y", "z")).alias("c")).first()
    assert (row["a"], row["b"]) == (1.0, 0.0) and row["c"] == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("a", "b", "level"),
    [((None, None, None, True), ("1-2", "1", None, False), "unreliable"), (("1-2", "1", "e1", False), ("1-2", "1", "e2", False), "mismatch"), (("1-2", "1", None, False), ("1-2", "1", None, False), "exact"), (("1-2", "1", None, False), ("1-9", "1", None, False), "compatible"), (("1-2", None, None, False), ("3-4", "3", None, False), "mismatch"), (("", "", None, False), ("3-4", "3", None, False), "missing")],
)
def test_pages(spark, a, b, level):
    cols = [F.lit(x).cast("boolean" if i == 3 else "string") for i in range(4) for x in (a[i], b[i])]
    assert spark.range(1).select(C.pages(*cols).level.alias("x")).first()["x"] == level


def test_pair_scores_and_decisions(spark, records):
    candidates = B.generate_candidates(records, [B.DoiBlocker(), B.YearTitleBlocker()])
    scores = pairs.score_pairs(candidates, records).cache()
    found = place(records, scores)
    assert found[0, 1]["comparison"]["doi"]["level"] == "exact" and found[0, 1]["comparison"]["year"]["level"] == "pm1"
    assert found[0, 2]["comparison"]["year"]["level"] == "pm2" and found[0, 2]["comparison"]["journal"]["level"] == "low"
    assert [c["field"] for c in found[0, 1]["explain"]["top_contributions"]][:2] == ["doi", "title"] and len(found[0, 1]["explain"]["top_contributions"]) == 5
    decided = place(records, decide.decide(scores, records))
    assert decided[0, 1]["decision"] == "AUTO_DUP" and decided[0, 1]["reasons"][0]["code"] == "p_above_t_high"
    lost = candidates.union(spark.createDataFrame([("x|y", "x", "y", [])], candidates.schema))
    assert pairs.missing_pairs(lost, records).count() == 1 and pairs.score_pairs(lost, records).count() == len(found)
    assert decide.decide(scores.limit(0), records).count() == 0
    assert {r["bucket"]: r["n_pairs"] for r in pairs.score_statistics(scores).collect()}["0.9-1.0"] == 3


def test_gates_come_before_probability(spark):
    text = samples.ris({"TI": "Same title here", "DO": "10.1/a", "PY": "2000"}, {"TI": "Same title here", "DO": "10.1/b", "PY": "2000"}, {"TI": "Retraction of that...", "PY": "2000"}, {"TI": "Retraction of that...", "PY": "2000"})
    records = samples.normalized(spark, text)
    rid = [r["rid"] for r in records.collect()]
    made = [(0, 1, 0.01), (2, 3, 0.99)]
    rows = [("|".join(sorted((rid[a], rid[b]))), *sorted((rid[a], rid[b])), p, ["title_truncated"] if a == 2 else []) for a, b, p in made]
    scores = spark.createDataFrame(rows, "pair_id string, rid_a string, rid_b string, p_match double, warnings array<string>")
    codes = {r["p_match"]: ([c["code"] for c in r["reasons"]], r["decision"]) for r in decide.decide(scores, records).collect()}
    assert codes[0.01] == (["forced_review_conflicting_doi"], "REVIEW")
    # a repeated record has one rid, so the pair (2, 3) is a record with itself
    assert codes[0.99] == (["forced_review_title_truncated", "forced_review_retraction_notice"], "REVIEW")
    summary = decide.decision_summary(decide.decide(scores, records)).first()
    assert (summary["review"], summary["forced_review_conflicting_ids"], summary["forced_review_data_quality"], summary["forced_review_special_records"]) == (2, 1, 1, 1)
    assert decide.categorize("forced_review_erratum_notice") == "special_records" and decide.categorize("p_below_t_low") is None


def labelled(spark, rows):
    return spark.createDataFrame(rows, "p_match double, is_duplicate boolean")


def test_np_by_hand(spark):
    rows = [(0.9, True)] * 5 + [(0.8, False)] + [(0.7, True)] * 5 + [(0.6, False)] * 9
    found = calibrate.calibrate_np(labelled(spark, rows), 0.1, min_pairs=1)
    assert (found.threshold, found.estimated_fpr) == (0.7, 0.1) and found.confusion_matrix.to_dict() == {"tp": 10, "fp": 1, "tn": 9, "fn": 0}
    assert calibrate.calibrate_np(labelled(spark, [(0.9, False), (0.5, True)]), 0.1, min_pairs=1).threshold == math.inf
    assert calibrate.calibrate_np(labelled(spark, [(0.9, True), (0.5, True)]), 0.1, min_pairs=1).threshold == 0.5
    with pytest.raises(ValueError, match="at least"):
        calibrate.calibrate_np(labelled(spark, rows), 0.1)
    with pytest.raises(ValueError, match="no calibration"):
        calibrate.calibrate_np(labelled(spark, []), 0.1)


def brute_conformal(rows, alpha, delta):
    n, best = len(rows), None
    eps = math.sqrt(math.log(2 / delta) / (2 * n))
    for t in {s for s, _ in rows}:
        kept = [y for s, y in rows if s >= t]
        room = (n + 1) * alpha * max(len(kept) / n - eps, 0)
        if room >= 1 and kept.count(False) <= math.ceil(room) - 1:
            best = t if best is None else min(best, t)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_conformal_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(round(rng.random(), 2), rng.random() < 0.8) for _ in range(300)]
    found = calibrate.calibrate_conformal(labelled(spark, rows), 0.2, 0.1)
    assert found.t_high_conformal == (brute_conformal(rows, 0.2, 0.1) or math.inf)
    assert calibrate.final_threshold(0.4, found)[0] == max(0.4, found.t_high_conformal) and calibrate.final_threshold(0.4, None) == (0.4, 0.4, None)
    with pytest.raises(ValueError, match="alpha"):
        calibrate.calibrate_conformal(labelled(spark, rows), 0, 0.1)


def test_large_blocks_and_long_records(spark):
    keys = spark.createDataFrame([(f"r{i}", "big") for i in range(9)] + [("r0", "big"), ("r1", "small"), ("r2", "small")], "rid string, block_key string")
    assert [tuple(r) for r in B.large_blocks(keys, limit=3).collect()] == [("big", 9)]
    assert B.block_statistics(keys, keys.select("rid").distinct()).first()["max_block"] == 9
    tokens = [f"t{i % 300}" for i in range(30_000)]
    rows = spark.createDataFrame([("long", tokens), ("short", tokens[:300]), ("few", ["a"]), ("none", []), ("null", None)], "rid string, tokens array<string>")
    bands = {r["rid"]: set() for r in rows.collect()}
    for r in B.minhash_bands(rows, min_tokens=2).collect():
        bands[r["rid"]].add(r["block_key"])
    assert bands["long"] == bands["short"] and len(bands["long"]) == B.BANDS and not bands["few"] | bands["none"] | bands["null"], "a record over several chunks has one signature"
    hashes = {r["rid"]: r["block_key"] for r in B.simhash_chunks(rows).filter("block_key like 'sh:c0:%'").collect()}
    assert hashes["long"] == hashes["short"] and set(hashes) == {"long", "short", "few"}


def test_few_splits_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spread(spark.read.option("maxPartitionBytes", "1k").parquet(str(tmp_path / name))) for name in ("one", "many"))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 1000
    assert many.count() == 1000
