"""``spark.read.format("bibliography").load(path)``: the parsers as a Python data source, one partition a file."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from amalgam.clock import iso, iso_now
from amalgam.schema import PARSED
from amalgam.sources import parsers


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = Path(self.options["path"].removeprefix("file:"))
        if not root.exists():
            raise FileNotFoundError(str(root))
        recursive = self.options.get("recursive", "false").lower() == "true"
        found = [root] if root.is_file() else sorted((root.rglob if recursive else root.glob)(self.options.get("pattern", "*")))
        return [_File(str(p)) for p in found if p.is_file() and p.suffix.lower() in parsers.EXTENSIONS]

    def read(self, partition: _File) -> Iterator[tuple]:
        path = Path(partition.path)
        modified = iso(datetime.fromtimestamp(path.stat().st_mtime, UTC))
        rows, _ = parsers.read_content(path.name, path.read_bytes(), modified, iso_now())
        for row in rows:
            raw = row["raw"]
            tags = [tuple(t.values()) for t in raw["tags"]]
            yield (row["schema_version"], row["rid"], row["record_digest"], row["source_digest"], tuple(row["meta"].values()), (raw["record_lines"], tags, raw["unknown_lines"]))


class Bibliography(DataSource):
    """Options: path, recursive, pattern. The path is on a file system that all executors mount; else use ``files.read_records``."""

    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return PARSED

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bibliography)
