"""Files and folders to record DataFrames: a binary file scan, then one parser call a file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from amalgam.clock import iso, iso_now
from amalgam.schema import PARSED, struct_type
from amalgam.session import cut
from amalgam.sources import parsers

REPORT = "filename string, filepath string, file_size bigint, file_mtime string, format_detected string, source_ext string, encoding_used string, records_parsed int, tags_parsed int, warnings array<string>, errors array<string>, file_digest string"


def bibliographic_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None, streaming: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the files with a known extension; ``pattern`` is a glob for names."""
    known = "*.{" + ",".join(x[1:] for x in parsers.EXTENSIONS) + "," + ",".join(x[1:].upper() for x in parsers.EXTENSIONS) + "}"
    reader = (spark.readStream if streaming else spark.read).schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern or known)
    files = reader.load(path)
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*parsers.EXTENSIONS))


def _read(row: dict, ingested: str) -> tuple[list[dict], dict]:
    modified = iso(row["modificationTime"])
    name = PurePosixPath(row["path"]).name
    rows, report = parsers.read_content(name, row["content"], modified, ingested)
    return rows, report | {"filepath": row["path"]}


def _rows(files: DataFrame, ingested: str | None, records: bool, reports: bool) -> DataFrame:
    """``file`` (a report) of every file and ``record`` of every record; the other one is null."""
    ingested = ingested or iso_now()
    schema = T.StructType([T.StructField("record", struct_type(PARSED)), T.StructField("file", struct_type(REPORT))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                rows, report = _read(row, ingested)
                for at in range(0, len(rows) if records else 0, 2000):
                    yield pa.RecordBatch.from_pylist([{"record": r, "file": None} for r in rows[at : at + 2000]], arrow)
                if reports:
                    yield pa.RecordBatch.from_pylist([{"record": None, "file": report}], arrow)

    return files.select("path", "modificationTime", "content").mapInArrow(read, schema)


def parse_with_reports(files: DataFrame, ingested: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and reports of binary files, from one pass that reads and parses each file once; its rows are kept in the checkpoint folder."""
    rows = cut(_rows(files, ingested, True, True))
    return rows.filter("record is not null").select("record.*"), rows.filter("file is not null").select("file.*")


def parse_files(files: DataFrame, ingested: str | None = None) -> DataFrame:
    """Records (``schema.PARSED``) of binary files, in no particular order; meta has file and index."""
    return _rows(files, ingested, True, False).select("record.*")


def file_reports(files: DataFrame, ingested: str | None = None) -> DataFrame:
    """One row for each file: what was detected, how much was parsed, warnings and errors."""
    return _rows(files, ingested, False, True).select("file.*")


def read_records(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Parsed records of a file or folder."""
    return parse_files(bibliographic_files(spark, path, recursive, pattern))
