import json
from pathlib import Path

import pytest

from amalgam import CanonicalRecord, api, cli
from amalgam.audit import AuditLogger, ManifestWriter, RunContext, schemas
from amalgam.engine import PipelineConfig, run_pipeline
from amalgam.operators.normalize import normalize
from amalgam.records import to_frame
from amalgam.sinks.jsonl import write_jsonl, write_jsonl_file
from amalgam.sinks.ris import write_ris_file
from amalgam.sources.files import bibliographic_files, parse_files
from amalgam.sources.tables import read_canonical, read_clusters, read_decisions, read_scores
from amalgam.streaming.files import append_records, stream_records
from tests import samples

PAIR = {"TI": "A common title", "AU": "Smith, John", "PY": "2020", "DO": "10.1/a", "JF": "J"}
TEXT = samples.ris(PAIR, PAIR | {"AB": "text", "PM": "7"}, {"TI": "Alone", "PY": "1999"})


def lines(path):
    if Path(path).is_file():
        return [json.loads(x) for x in Path(path).read_text().splitlines()]
    return [json.loads(x) for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def test_whole_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ris").write_text(TEXT)
    result = run_pipeline(tmp_path / "in", PipelineConfig(output_dir=tmp_path / "out", single_files=True, track_execution_time=True), spark=spark)
    assert result.success, result.error_message
    assert (result.total_records, result.total_candidates, result.total_duplicates_auto, result.total_unique_records) == (3, 1, 1, 2)
    assert result.dedup_rate == pytest.approx(1 / 3, abs=1e-4)
    (merged,) = lines(result.output_files["merged_records"])
    assert merged["canon"]["pmid_norm"] == "7" and list(merged) == sorted(merged) and merged["canon"]["abstract_raw"] == "text"
    text = Path(result.output_files["deduplicated_ris"]).read_bytes().decode()
    assert text.startswith("TY  - JOUR\r\nTI  - A common title\r\nAB  - text\r\nAU  - Smith, John\r\n") and text.endswith("ER  -")
    assert "singletons_ris" in result.output_files and "review_pending_ris" not in result.output_files
    summary = json.loads(Path(result.output_files["merge_summary"]).read_text())
    assert summary["singletons_count"] == 1 and summary["execution_time_seconds"] > 0
    assert json.loads(Path(result.output_files["ingestion_report"]).read_text())["total_records"] == 3
    scoring = json.loads(Path(result.output_files["scoring_statistics"]).read_text())
    assert (scoring["pairs_in"], scoring["pairs_scored"], scoring["pairs_skipped_missing_records"]) == (1, 1, 0) and sum(scoring["p_match_buckets"].values()) == 1 and "title_truncated_pairs" in scoring["warnings"]
    blocks = json.loads(Path(result.output_files["candidate_statistics"]).read_text())
    assert blocks["blockers"]["doi_exact"]["max_block"] == 2 and not blocks["oversized_blocks"]
    (decision,) = lines(result.output_files["decisions"])
    assert decision["thresholds"]["t_high"] == 0.95 and decision["conformal"] is None and decision["np"] is None
    with AuditLogger("r", tmp_path / "events.jsonl") as log:
        again = run_pipeline(f"file://{tmp_path}/in", PipelineConfig(output_dir=tmp_path / "out2"), spark=spark, logger=log)
    assert lines(again.output_files["merged_records"]) == [merged]
    assert not [p for line in lines(tmp_path / "events.jsonl") for p in schemas.problems(line, schemas.event_schema())] and len(lines(tmp_path / "events.jsonl")) == 12


def test_calibrated_decisions_say_by_what(spark, tmp_path):
    (tmp_path / "a.ris").write_text(TEXT)
    rows = [{"pair_id": f"p{i}", "p_match": (0.95 if i < 250 else 0.1) + i / 100_000, "is_duplicate": i < 250} for i in range(500)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    config = PipelineConfig(output_dir=tmp_path / "out", single_files=True, calibration=str(tmp_path / "c.jsonl"), conformal_delta=0.05)
    result = run_pipeline(tmp_path / "a.ris", config, spark=spark)
    assert result.success, result.error_message
    (decision,) = lines(result.output_files["decisions"])
    assert decision["conformal"]["method"] == "scrc_i" and decision["np"]["method"] == "neyman_pearson" and decision["np"]["calibration_size"] == 500
    assert decision["thresholds"]["t_high_np"] <= 0.96 and list(read_decisions(spark, result.output_files["decisions"]).first()["reasons"][0].asDict()) == ["code"]


def test_written_stages_are_read(spark, tmp_path):
    (tmp_path / "a.ris").write_text(TEXT)
    out = run_pipeline(tmp_path / "a.ris", PipelineConfig(output_dir=tmp_path / "out"), spark=spark).output_files
    assert read_clusters(spark, out["clusters"]).filter("status = 'AUTO'").first()["support"]["edges_auto_dup"] == 1
    assert read_scores(spark, out["scored_pairs"]).first()["explain"]["top_contributions"][0]["field"] == "doi"
    (tmp_path / "d.jsonl").write_text('{"pair_id": "a|b", "rid_a": "a", "rid_b": "b", "decision": "AUTO_DUP", "reasons": ["doi_exact", {"code": "x"}]}\n')
    row = read_decisions(spark, str(tmp_path / "d.jsonl")).first()
    assert row["p_match"] == 0.0 and [r["code"] for r in row["reasons"]] == ["doi_exact", "x"]
    record = CanonicalRecord.from_row(read_canonical(spark, out["canonical_records"]).filter("canon.title_raw = 'Alone'").first())
    assert record.canon.title_raw == "Alone" and record.flags.doi_present is False and record.raw.tags[0].tag == "TY"
    assert CanonicalRecord.from_dict(json.loads(json.dumps(record.to_dict()))) == record and to_frame(spark, [record]).first()["rid"] == record.rid
    bare = CanonicalRecord.from_dict({"rid": "r", "raw": {"tags": [{"tag": "TI"}]}, "odd": 1})
    assert bare.raw.tags[0].value_lines == [] and bare.meta.source_format == "unknown" and bare.canon.authors_raw is None and bare.provenance == {}


def test_single_files(spark, tmp_path):
    rows = spark.range(50).selectExpr("cast(50 - id as int) as n", "struct(concat('T', id) as title_raw) as canon").repartition(7)
    full = normalize(parse_files(bibliographic_files(spark, str(samples.write_all(tmp_path))))).select("rid", "canon")
    text = Path(write_ris_file(full, str(tmp_path / "o.ris"), "rid", line_end="\n")).read_text()
    assert text.count("ER  -") == 9 and text.count("ER  -\n\nTY") == 8 and text.endswith("ER  -")
    found = lines(write_jsonl_file(rows, str(tmp_path / "o.jsonl"), "n"))
    assert [r["n"] for r in found] == list(range(1, 51)) and not list(tmp_path.glob("*.parts-*"))
    assert Path(write_jsonl_file(rows.limit(0), str(tmp_path / "e.jsonl"), "n")).read_text() == ""


def test_failures_are_reported(spark, tmp_path):
    assert "does not exist" in run_pipeline(tmp_path / "none", spark=spark).error_message
    (tmp_path / "e.ris").write_text("nothing")
    empty = run_pipeline(tmp_path / "e.ris", PipelineConfig(output_dir=tmp_path / "o"), spark=spark)
    assert not empty.success and "no records" in empty.error_message
    (tmp_path / "f.ris").write_text(TEXT)
    bad = run_pipeline(tmp_path / "f.ris", PipelineConfig(output_dir=tmp_path / "p", candidate_blockers=["nope"]), spark=spark)
    assert not bad.success and "unknown blocker" in bad.error_message and bad.total_records == 3


@pytest.mark.parametrize("bad", [{"fpr_alpha": 2}, {"t_low": -1}, {"t_high": 1.5}, {"t_low": 0.5, "t_high": 0.4}])
def test_config(bad):
    with pytest.raises(ValueError):
        PipelineConfig(**bad)
    assert set(PipelineConfig().candidate_blockers) == {"year_title", "pmid", "doi"}


def test_api(spark, tmp_path):
    samples.write_all(tmp_path)
    assert api.parse_file(tmp_path / "a.ris").count() == 2 and api.parse_folder(tmp_path, pattern="*.ris").count() == 2
    with pytest.raises(api.ParseError):
        api.parse_file(tmp_path / "e.bib")
    assert api.parse_file(tmp_path / "e.bib", strict=False).count() == 1
    with pytest.raises(FileNotFoundError):
        api.parse_file(tmp_path / "none.ris")
    with pytest.raises(ValueError, match="not a folder"):
        api.parse_folder(tmp_path / "a.ris")
    with pytest.raises(api.ParseError):
        api.parse_folder(tmp_path, strict=True)
    api.write_jsonl(api.parse_file(tmp_path / "a.ris"), str(tmp_path / "x.jsonl"), "rid", single=True)
    assert len(lines(tmp_path / "x.jsonl")) == 2
    with pytest.raises(FileNotFoundError):
        api.dedupe(tmp_path / "none")
    assert api.dedupe(tmp_path / "a.ris", output_dir=tmp_path / "out").success


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.ris").write_text(TEXT)
    assert cli.main(["parse", str(tmp_path / "a.ris"), "-o", str(tmp_path / "o.jsonl")]) == 0
    assert cli.main(["deduplicate", str(tmp_path / "a.ris"), "-o", str(tmp_path / "out"), "--blockers", "doi, year_title", "-v"]) == 0
    assert "3 records" in capsys.readouterr().out
    assert cli.main(["parse", str(tmp_path / "none"), "-o", "x"]) == 1


def test_stream_gives_what_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    samples.write_all(tmp_path / "in")
    query = append_records(stream_records(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 9
    (tmp_path / "in" / "new.ris").write_text(samples.RIS.replace("Another", "New"))
    append_records(stream_records(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 11


def test_json_keys_are_sorted_and_nulls_stay(spark, tmp_path):
    write_jsonl(spark.createDataFrame([(1, None, ("x", "y"))], "b int, a string, c struct<z:string,y:string>"), str(tmp_path / "j"), single=True)
    text = next((tmp_path / "j").glob("part-*")).read_text().strip()
    assert text == '{"a":null,"b":1,"c":{"y":"y","z":"x"}}'


def test_audit(tmp_path):
    with RunContext.start(tmp_path / "run", {"x": 1}, ["cmd"]) as run:
        run.start_stage("one", 5)
        run.finish_stage("one", {"n": 5})
        with pytest.raises(ValueError, match="not started"):
            run.finish_stage("two")
    manifest = json.loads((tmp_path / "run" / "run.json").read_text())
    assert manifest["status"] == "success" and manifest["stages"][0]["counters"] == {"n": 5} and manifest["outputs"]["artifacts"][0]["path"] == "events.jsonl"
    events = [json.loads(x)["event"] for x in (tmp_path / "run" / "events.jsonl").read_text().splitlines()]
    assert " ".join(events) == "run_started stage_started stage_finished run_finished"
    with pytest.raises(RuntimeError), RunContext.start(tmp_path / "bad", {}, ["cmd"]):
        raise RuntimeError("x")
    assert json.loads((tmp_path / "bad" / "run.json").read_text())["status"] == "failed"
    with AuditLogger("r", tmp_path / "log.jsonl") as log:
        log.record_flagged("flag", "code", rid="rid", stage="s")
        log.artifact_written("p", "h", record_count=2)
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 2
    with pytest.raises(ValueError, match="no such stage"):
        ManifestWriter("r", tmp_path, {}, {}, "v", {}).finish_stage("none")


def test_audit_documents_follow_their_schemas(tmp_path):
    with RunContext.start(tmp_path / "run", {"x": 1}, ["cmd"]) as run:
        run.start_stage("one", 5)
        run.logger.record_flagged("flag", "code", rid="r")
        run.finish_stage("one", {"n": 5})
        run.record_error(ValueError("no"), stage="one")
    manifest, events = schemas.manifest_schema(), schemas.event_schema()
    written = json.loads((tmp_path / "run" / "run.json").read_text())
    assert schemas.problems(written, manifest) == [] and all(schemas.problems(e, events) == [] for e in lines(tmp_path / "run" / "events.jsonl"))
    assert schemas.problems(written | {"status": "odd"}, manifest) and schemas.problems({k: v for k, v in written.items() if k != "run_id"}, manifest)
    good = dict(ts="2024-01-01T00:00:00.0Z", run_id="r", level="INFO", event="stage_started", stage="s", data={})
    assert schemas.problems(good, events) == []
    for bad in ({"level": "LOUD"}, {"event": "other"}, {"stage": None}, {"ts": "today"}, {"event": "artifact_written", "data": {"path": "p", "sha256": "short"}}, {"event": "run_finished", "data": dict(status="success", duration_seconds=-1)}):
        assert schemas.problems(good | bad, events), bad
    schemas.main(str(tmp_path))
    for name, schema in (("log_event", events), ("run_manifest", manifest)):
        assert json.loads((tmp_path / f"{name}.schema.json").read_text()) == schema
