"""Functions for users: parse files and folders, write JSON lines, deduplicate. Paths may have any scheme that Hadoop knows."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from amalgam.engine import PipelineConfig, PipelineResult, run_pipeline
from amalgam.session import exists, is_folder, local_session
from amalgam.sinks.jsonl import write_jsonl, write_jsonl_file
from amalgam.sources.files import bibliographic_files, parse_files, parse_with_reports

__all__ = ["ParseError", "dedupe", "parse_file", "parse_folder", "write_jsonl", "write_jsonl_file"]


class ParseError(Exception):
    """A file that can't be parsed, or a run that failed; ``file`` is its path where there is one."""

    def __init__(self, what: str, path: str | None = None) -> None:
        super().__init__(what)
        self.file = path


def _records(files: DataFrame, strict: bool) -> DataFrame:
    """The records; if ``strict``, files are parsed at once, and errors in one of them raise."""
    if not strict:
        return parse_files(files)
    records, reports = parse_with_reports(files)
    failed = reports.filter("size(errors) > 0").select("filename", "filepath", "errors").take(3)
    if failed:
        raise ParseError("; ".join(f"{r['filename']}: {', '.join(r['errors'])}" for r in failed), failed[0]["filepath"])
    return records


def parse_file(path: str | Path, *, spark: SparkSession | None = None, strict: bool = True) -> DataFrame:
    """The records of a file, not normalized. ``strict``: errors in the file raise :class:`ParseError`."""
    spark, name = spark or local_session(), str(path)
    if not exists(spark, name):
        raise FileNotFoundError(f"no such file: {path}")
    if PurePosixPath(name).suffix.lower() not in _extensions() and strict:
        raise ParseError(f"no parser for {PurePosixPath(name).name}", name)
    return _records(bibliographic_files(spark, name), strict)


def _extensions() -> dict[str, str]:
    from amalgam.sources.parsers import EXTENSIONS

    return EXTENSIONS


def parse_folder(path: str | Path, *, recursive: bool = False, spark: SparkSession | None = None, strict: bool = False, pattern: str | None = None) -> DataFrame:
    """The records of all known files in a folder, not normalized."""
    spark, name = spark or local_session(), str(path)
    if not exists(spark, name):
        raise FileNotFoundError(f"no such folder: {path}")
    if not is_folder(spark, name):
        raise ValueError(f"not a folder: {path}")
    return _records(bibliographic_files(spark, name, recursive, pattern), strict)


def dedupe(input_path: str | Path, *, t_high: float | None = None, output_dir: str | Path = "out", t_low: float = 0.3, spark: SparkSession | None = None, fpr_alpha: float = 0.01) -> PipelineResult:
    """All stages over files; a failed run raises :class:`ParseError`."""
    spark = spark or local_session()
    if not exists(spark, str(input_path)):
        raise FileNotFoundError(f"no such input: {input_path}")
    result = run_pipeline(input_path, PipelineConfig(output_dir, t_high=t_high, fpr_alpha=fpr_alpha, t_low=t_low), spark=spark)
    if not result.success:
        raise ParseError(f"deduplication failed: {result.error_message}")
    return result
