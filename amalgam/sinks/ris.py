"""RIS as a column expression and a text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.sinks.files import write_one_file

LINE_END = "\r\n"


def ris_text(canon: Column, languages: Column) -> Column:
    """One record in RIS, lines joined by CRLF. ``canon`` is a struct column; ``languages`` an array."""
    line = lambda tag, value: F.when(value != "", F.array(F.concat(F.lit(f"{tag}  - "), value))).otherwise(F.array().cast("array<string>"))
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    name = lambda a: F.when(there(a["family"]), F.when(there(a["given"]), F.concat_ws(", ", a["family"], a["given"])).otherwise(a["family"])).when(there(a["raw"]), a["raw"])
    none = F.array().cast("array<string>")
    names = F.filter(F.coalesce(F.transform(canon["authors_parsed"], name), none), lambda n: n.isNotNull())
    field = lambda tag, path: line(tag, canon[path])
    return F.array_join(
        F.concat(
            F.array(F.lit("TY  - JOUR")),
            field("TI", "title_raw"),
            field("AB", "abstract_raw"),
            F.transform(names, lambda n: F.concat(F.lit("AU  - "), n)),
            line("PY", F.nullif(canon["year_norm"], F.lit(0)).cast("string")),
            field("T2", "journal_full"),
            field("VL", "volume"),
            field("IS", "issue"),
            field("SP", "page_first"),
            field("EP", "page_last"),
            field("DO", "doi_norm"),
            field("UR", "doi_url"),
            F.transform(F.coalesce(languages, none), lambda x: F.concat(F.lit("LA  - "), x)),
            F.array(F.lit("ER  -")),
        ),
        LINE_END,
    )


def _values(df: DataFrame, order: str) -> DataFrame:
    language = df.schema["canon"].dataType["language"].dataType.simpleString()
    languages = F.col("canon.language") if language.startswith("array") else F.when(F.col("canon.language") != "", F.array("canon.language"))
    return df.select(order, ris_text(F.col("canon"), languages).alias("value"))


def to_ris(df: DataFrame, order: str) -> DataFrame:
    """A single column ``value`` of RIS records; ``df`` has canon (language a string or a list) and the column to sort each part by."""
    return _values(df, order).sortWithinPartitions(order).select("value")


def write_ris(df: DataFrame, path: str, order: str, single: bool = False) -> None:
    """Text parts of records with a blank line between; ``single`` gives one part in global order, for small results."""
    rows = df.coalesce(1) if single else df
    to_ris(rows, order).write.mode("overwrite").option("lineSep", LINE_END * 2).text(path)


def write_ris_file(df: DataFrame, path: str, order: str, line_end: str = LINE_END) -> str:
    """One RIS file of merged or of single records (anything with canon), sorted by ``order``: a blank line between records, nothing after the last one."""
    return write_one_file(_values(df, order), path, order, line_end * 2, ended=False)
