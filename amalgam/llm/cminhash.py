"""Near duplicates by circulant MinHash: one permutation, then a second one, circularly shifted, for every signature coordinate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.buckets import near_groups
from amalgam.llm.words import mix64, tidy, word_hashes
from amalgam.session import cut, filter_by_ids, one_row_per_id

#: Words of a shingle, bands, rows of a band, and the least Jaccard similarity of near duplicates.
SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
SEED = 9
_CHUNK = 1024


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, of which ``h`` has the hashes, repeats included; of a shorter text the one run it has; nothing without words."""
    if not len(h):
        return h
    run = min(size, len(h))
    out = h[: len(h) - run + 1].copy()
    for i in range(1, run):
        out = mix64(out) + h[i : len(h) - run + 1 + i]
    return mix64(out + np.uint64(run))


class Circulant:
    """Two permutations of the 32-bit universe. Coordinate k is the least pi((sigma(x) + k) mod 2**32) over the shingles x."""

    def __init__(self, coordinates: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.sigma = rng.integers(1 << 31, 1 << 32, 2, np.uint32) | np.uint32(1)
        self.pi = rng.integers(1 << 31, 1 << 32, 3, np.uint32) | np.uint32(1)
        self.shift = np.arange(coordinates, dtype=np.uint32)[:, None]

    def first(self, x: np.ndarray) -> np.ndarray:
        y = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for odd in self.sigma:
            y = y * odd
            y ^= y >> np.uint32(16)
        return y

    def second(self, y: np.ndarray) -> np.ndarray:
        """In place. Odd factors and shifted exclusive ors are bijections, so this is a permutation."""
        for odd, shift in zip(self.pi, (15, 13, 16), strict=True):
            y *= odd
            y ^= y >> np.uint32(shift)
        return y

    def signature(self, x: np.ndarray) -> np.ndarray:
        y = self.first(x)
        least = np.full(len(self.shift), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(y), _CHUNK):
            np.minimum(least, self.second(y[None, at : at + _CHUNK] + self.shift).min(1), out=least)
        return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    s = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2])
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """doc_id, a hash of its word sequence and its band keys, for documents with words."""
    minhash = Circulant(bands * rows, seed)
    for batch in _slices(batches):
        ids, prints, signatures = [], [], []
        for doc, words in zip(batch["doc_id"].to_pylist(), word_hashes(batch["text"]), strict=True):
            if len(x := shingles(words, size)):
                ids.append(doc)
                prints.append(xxhash.xxh128_digest(x.tobytes()))
                signatures.append(minhash.signature(x))
        if ids:
            keys = band_keys(np.stack(signatures), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "print": pa.array(prints, pa.binary()), "keys": lists})


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [np.unique(shingles(words, size)).view(np.int64) for words in word_hashes(batch["text"])]
        ends = np.cumsum([0, *map(len, sets)])
        yield pa.record_batch({"doc_id": batch["doc_id"], "set": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))})


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, group_id (the least doc_id of its group) and keep (whether doc_id is that one), for every doc_id.

    Documents belong together when a chain of pairs joins them, each with an exact Jaccard similarity of at least ``threshold`` between
    their sets of ``size``-word shingles and one of ``bands`` bands of the signature in common (a pair at 0.5 does with a probability
    of 0.92, at 0.6 with 0.996). Equal word sequences are grouped before banding, so that copies cost nothing.

    * Null or empty text, or text without a word: a group of its own. Null doc_id: left out.
    * Fewer than ``size`` words: the whole word sequence is the one shingle.
    * Repeated rows of a doc_id: one row; the one with the least text counts.
    * Whole texts at any length. Only doc_id and text are used, so further columns don't matter.
    """
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null"), "doc_id")
    signed = cut(docs.mapInArrow(lambda it: tidy(_sign(it, bands, rows, size, seed)), "doc_id bigint, print binary, keys array<bigint>"))
    copies = cut(signed.groupBy("print").agg(F.min("doc_id").alias("first"), F.collect_set("doc_id").alias("all")).filter("size(all) > 1").select("first", F.explode("all").alias("doc_id")).filter("first <> doc_id"))
    distinct = filter_by_ids(signed, copies.select("doc_id"), "doc_id", keep=False)
    members = distinct.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        sets = filter_by_ids(docs, ids, "doc_id", keep=True).mapInArrow(lambda it: tidy(_sets(it, size)), "doc_id bigint, set array<bigint>")
        both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard")).filter(F.col("jaccard") >= threshold).select("a", "b")

    groups = near_groups(members, verify)
    named = copies.join(groups.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("group_id"))
    named = named.union(groups.select("node", "component"))
    return (
        docs.select("doc_id")
        .join(named, "doc_id", "left")
        .select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), (F.coalesce("group_id", "doc_id") == F.col("doc_id")).alias("keep"))
    )


def drop_near_duplicates(docs: DataFrame, **parameters: float) -> DataFrame:
    """The rows of ``docs`` that lead their group; parameters as in ``near_duplicate_groups``.

    Rows with a null doc_id stay. Of repeated rows of a doc_id one stays. All columns are kept.
    """
    docs = one_row_per_id(docs, "doc_id")
    gone = cut(near_duplicate_groups(docs, **parameters).filter("not keep").select("doc_id"))
    return filter_by_ids(docs, gone, "doc_id", keep=False)
