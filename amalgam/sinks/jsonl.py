"""JSON lines with keys in order, and nulls as in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amalgam.sinks.files import write_one_file


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """The same value with the fields of all structs in order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[in_key_order(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), in_key_order(e["value"], kind.valueType).alias("value"))))) if isinstance(kind.valueType, (T.StringType, T.NumericType)) else value
    return value


def to_json_lines(df: DataFrame, sort_keys: bool = True, *beside: str) -> DataFrame:
    """A single column ``value``, and the columns ``beside`` it."""
    fields = sorted(df.schema.fields, key=lambda f: f.name) if sort_keys else df.schema.fields
    row = F.struct(*[(in_key_order(F.col(f.name), f.dataType) if sort_keys else F.col(f.name)).alias(f.name) for f in fields])
    return df.select(*beside, F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, single: bool = False, sort_keys: bool = True) -> None:
    """Parts of JSON lines; ``single`` gives one part, sorted by ``order``, for small results."""
    rows = df.coalesce(1) if single else df
    if order:
        rows = rows.sortWithinPartitions(order)
    to_json_lines(rows, sort_keys).write.mode("overwrite").text(path)


def write_jsonl_file(df: DataFrame, path: str, order: str, sort_keys: bool = True) -> str:
    """One file of JSON lines, sorted by ``order``; each line is ended."""
    return write_one_file(to_json_lines(df, sort_keys, order), path, order)
