"""Single records in Python, for those who look at one at a time: a view of a row, and back."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from amalgam.schema import RECORD, SCHEMA_VERSION, struct_type

#: What stands for a value that a dict doesn't have, where that isn't None; other lists of raw are empty.
_DEFAULTS = {"schema_version": SCHEMA_VERSION, "source_format": "unknown"} | dict.fromkeys("rid record_digest source_file ingested_at value_raw_joined".split(), "")
_DEFAULTS |= dict.fromkeys("source_record_index occurrence line_start line_end".split(), 0)


class Part:
    """The fields of a struct as attributes."""

    def __init__(self, values: Mapping[str, object]) -> None:
        self.__dict__.update(values)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Part) and self.__dict__ == other.__dict__

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if v is not None)})"


def _plain(value: object) -> object:
    if isinstance(value, Part):
        return {k: _plain(v) for k, v in value.__dict__.items()}
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def _shaped(value: object, kind: T.DataType, name: str = "", inside: str = "") -> object:
    """A plain value as its type has it: structs as parts with all fields, missing ones by their defaults."""
    if isinstance(kind, T.StructType):
        given = value or {}
        return Part({f.name: _shaped(given.get(f.name), f.dataType, f.name, name or inside) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        if value is None:
            return [] if inside in ("raw", "tags") else None
        return [_shaped(v, kind.elementType, name) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _plain(v) for k, v in (value or {}).items()}
    if value is None:
        return False if isinstance(kind, T.BooleanType) else _DEFAULTS.get(name)
    return value


class CanonicalRecord(Part):
    """A normalized record: ``record.canon.title_raw``, ``record.flags.title_missing``."""

    @classmethod
    def from_dict(cls, data: Mapping[str, object]) -> CanonicalRecord:
        """From a row's or a JSON object's dict; what it lacks is None, empty or False as in a new record, and what isn't in the schema is dropped."""
        return cls(_shaped(_plain(data), struct_type(RECORD)).__dict__)

    @classmethod
    def from_row(cls, row: Row) -> CanonicalRecord:
        return cls.from_dict(row.asDict(recursive=True))

    def to_dict(self) -> dict[str, object]:
        """All fields; ``from_dict`` gives an equal record."""
        return _plain(self)


def to_frame(spark: SparkSession, records: Iterable[CanonicalRecord]) -> DataFrame:
    """A DataFrame of records that a program made itself."""
    return spark.createDataFrame([r.to_dict() for r in records], struct_type(RECORD))
