"""Session helpers: checkpoint folder, lineage cuts and size-checked joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A join side of at most this many rows of one id is broadcast (about 32 MB as a hash relation); a larger one is shuffled.
BROADCAST_IDS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share: ``spark.checkpoint.dir``. Only a local session may leave it out; it gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="amalgam-checkpoint-"))
    return context.getCheckpointDir()


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system, whatever the scheme."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    target, files = hadoop_path(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, or, for a pattern, one that matches."""
    target, files = hadoop_path(spark, path)
    return files.exists(target) or bool(files.globStatus(target))


def is_folder(spark: SparkSession, path: str) -> bool:
    target, files = hadoop_path(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the checkpoint folder; it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str, keep: bool) -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``keep``) or isn't among ``ids``, a cut DataFrame of one column ``key`` without repeats.

    The ids are counted: few are broadcast, so that wide rows stay where they are; many are joined by a shuffle.
    A null key is never among the ids.
    """
    n = ids.count()
    side = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge")
    return df.join(side, key, "left_semi" if keep else "left_anti")


def spread(df: DataFrame) -> DataFrame:
    """``df``, or, where its scan makes far fewer tasks than there are cores (a small file of one row group), the same rows dealt out to all of them.

    Large inputs have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() <= cores // 2 else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each ``key``: the one with the highest ``order``, of equals the one with the greatest text form; aggregated, without a sort."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    return df.groupBy(key).agg(F.max_by(row, F.struct(F.col(order), F.to_json(row))).alias("row__")).select(key, *[F.col(f"row__.{c}").alias(c) for c in rest])


def one_row_per_id(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each value of ``key``: of repeated rows, the one with the least text form stays.

    Rows with a null key all stay. Only the rows of repeated keys are shuffled.
    """
    n, rank = unused(df, "n__"), unused(df, "rank__")
    repeated = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).filter(F.col(key).isNotNull()).select(key))
    if repeated.isEmpty():
        return df
    rest = filter_by_ids(df, repeated, key, keep=False)
    order = F.to_json(F.struct(*[df[c] for c in df.columns]))
    first = (
        filter_by_ids(df, repeated, key, keep=True)
        .withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(order)))
        .filter(F.col(rank) == 1)
        .drop(rank)
    )
    return rest.unionByName(first)


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """The active session, or a local one."""
    builder = SparkSession.builder.appName("amalgam")
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()
