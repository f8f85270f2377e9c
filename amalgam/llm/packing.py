"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amalgam.llm.words import count_tokens
from amalgam.session import cut

#: Tokens of a training sequence.
CAPACITY = 2048
#: Documents that a group has on average.
GROUP_DOCS = 8192
SEED = 20

#: Parts in which the rows of one document are numbered.
_SALTS = 64

SCHEMA = "doc_id bigint, epoch bigint, piece int, piece_start bigint, n_tokens bigint, pack_group bigint, bin int, bin_offset bigint"


class CapacityTree:
    """Tournament tree over bins in order of opening; an inner node holds the larger free capacity of its two children."""

    def __init__(self, capacity: int, bins: int) -> None:
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the leftmost bin with room; the bin and its free capacity before. The tree has room for every piece."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        at = node
        while at > 1:
            at >>= 1
            a, b = free[2 * at], free[2 * at + 1]
            free[at] = a if a >= b else b
        return node - self.leaves, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in the bin for sizes that already decrease; none is above ``capacity``."""
    tree = CapacityTree(capacity, len(sizes))
    bins, offsets = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        bins[i], had = tree.first_fit(size)
        offsets[i] = capacity - had
    return bins, offsets


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    lengths = table["n"].to_numpy()
    ids, epoch = table["doc_id"], table["epoch"].to_numpy()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy()
    pieces = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, lengths[doc] - piece * capacity)
    order = np.lexsort((piece, epoch[doc], plain[doc], known[doc], -size))
    doc, piece, size = doc[order], piece[order], size[order]
    bins, offsets = first_fit_decreasing(size, capacity)
    return pa.table(
        {
            "doc_id": pa.array(plain[doc], pa.int64(), mask=~known[doc]),
            "epoch": pa.array(epoch[doc], pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "piece_start": pa.array(piece * capacity, pa.int64()),
            "n_tokens": pa.array(size, pa.int64()),
            "pack_group": pa.array(np.full(len(doc), table["g"][0].as_py()), pa.int64()),
            "bin": pa.array(bins, pa.int32()),
            "bin_offset": pa.array(offsets, pa.int64()),
        }
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Pieces of documents with their place in bins of ``capacity`` tokens.

    A token is a run of characters other than ASCII whitespace. The rows of a document are its epochs, from 0. Documents go by a seeded hash of doc_id into groups
    of ``group_docs`` on average, each epoch into the group after the one before, so that a sequence doesn't repeat a document unless it has more epochs than there
    are groups. Each group is packed by itself: pieces in order of size (longest first), then doc_id (null first), epoch and piece, each
    into the first bin that has room. Columns: doc_id, epoch, piece (from 0), piece_start (its first token), n_tokens, pack_group, bin (within the group), bin_offset.

    * A document longer than ``capacity`` is cut into full pieces and a rest; nothing of it is lost.
    * Null or empty text, or nothing but whitespace: no piece.
    * Repeated rows are epochs, with texts of fewer tokens first. Null doc_id: packed as a document of its own for each text.
    * An empty table gives an empty result. Only doc_id and text are read, so further columns don't matter.
    """
    if capacity < 1 or group_docs < 1:
        raise ValueError("capacity and group_docs must be positive")
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    sized = docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(doc_id).alias("same"), count_tokens(text).alias("n")).filter("n > 0").withColumn("salt", F.spark_partition_id() % _SALTS)
    # equal rows are counted, not shuffled one by one; then their numbers are dealt out in parts
    counted = cut(sized.groupBy("doc_id", "same", "n", "salt").agg(F.count(F.lit(1)).alias("rows")))
    groups = max(1, -(-int(counted.agg(F.sum("rows")).first()[0] or 0) // group_docs))
    upto = Window.partitionBy("doc_id", "same").orderBy("n", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum("rows").over(upto) - F.col("rows")
    numbered = counted.withColumn("first", first).select("doc_id", "same", "n", F.explode(F.sequence("first", F.col("first") + F.col("rows") - 1)).alias("epoch"))
    placed = numbered.withColumn("g", F.pmod(F.pmod(F.xxhash64(F.lit(seed), "same"), F.lit(groups)) + F.col("epoch"), F.lit(groups)))
    return placed.select("doc_id", "epoch", "n", "g").groupBy("g").applyInArrow(lambda table: _pack_group(table, capacity), SCHEMA)


def naive_first_fit(sizes: list[int], capacity: int) -> list[int]:
    """First fit by scanning all bins; for tests."""
    free: list[int] = []
    out = []
    for size in sizes:
        at = next((i for i, x in enumerate(free) if x >= size), len(free))
        if at == len(free):
            free.append(capacity)
        free[at] -= size
        out.append(at)
    return out
