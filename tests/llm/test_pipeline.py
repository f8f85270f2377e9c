"""The pipeline against its parts and brute force, over a small corpus."""

import random

import pytest

import corpus_pipeline
from amalgam.llm.queries import ORACLES, QUERIES
from tests.llm import cases


def write_corpus(spark, folder):
    rng = random.Random(11)
    passage = cases.words(rng, 70)
    rows, labels = [], []
    for i in range(200):
        w, bad = cases.words(rng, rng.randrange(40, 200)).split(), i % 5 == 0
        if bad:
            w[len(w) // 2 : len(w) // 2] = ["vilezz", "scumqo"]
        text = " ".join(w)
        if i % 7 == 1:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 2}"))
        if i < 150:
            labels.append((i, 1, int(bad)))
    rows += [(300 + i, rows[i][1] + " end", "en", "s0") for i in range(1, 20, 6)]
    cases.table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}, passage


def test_stages_in_turn(spark, tmp_path):
    texts, passage = write_corpus(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
    clean, unique, cut, mixed, packed = seen
    kept = {r["doc_id"] for r in clean}
    bad = {i for i, t in texts.items() if "vilezz" in t}
    assert len(kept & bad) <= 1 and len(set(texts) - bad - kept) <= 2
    sets = {i: cases.shingle_set(texts[i]) for i in kept}
    close = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in unique} == set(cases.groups_of(kept, close).values())
    assert {r["doc_id"] for r in cut} <= {r["doc_id"] for r in unique} and sum(passage in r["text"] for r in cut) == 1
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in cut} and len(mixed) > 0.8 * len(cut)
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].split()) for r in mixed)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed))


def test_odd_tables_go_through(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names, stage by stage; no text with a word is lost but the repeated ones."""
    odd = cases.odd(spark)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == odd.columns
            cases.own_columns_stay(docs)
        if name in ("toxicity", "near_duplicates", "repeats"):
            assert docs.filter("doc_id is null").count() == 1 and {1, 2, 3, 4, 5, 6, 7, 8, 10} <= {r["doc_id"] for r in docs.collect()}
    packed = docs.collect()
    assert {None, 4, 5, 6, 7, 8, 10} >= {r["doc_id"] for r in packed} >= {5} and len({(r["doc_id"], r["epoch"], r["piece"]) for r in packed}) == len(packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_an_empty_table_goes_through(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


SQL = sorted(ORACLES)


@pytest.mark.parametrize("name", SQL)
def test_queries_against_sql(spark, name):
    from pathlib import Path

    import duckdb

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables here")
    found = QUERIES[name](spark, str(data))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(repr(tuple(r[columns.index(c)] for c in found.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
