"""Near-duplicate embeddings by iterative quantisation: balanced binary codes, multi-index Hamming tables, exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.llm.buckets import near_groups
from amalgam.llm.words import tidy
from amalgam.operators.components import connected_components
from amalgam.session import cut, filter_by_ids, one_row_per_id

#: Least cosine of near duplicates; bits of one rotation at most; part of the pairs at the threshold that have to meet in a table.
THRESHOLD, BITS, RECALL = 0.9, 64, 0.995
#: Vectors that the codes are fitted on, at most; every vector is encoded.
SAMPLE = 8192
#: Passes that turn a rotation; how many rotations are turned, further ones being random, and with how many keys of a length are tried before they are made shorter.
ROUNDS, TURNED, ROTATIONS = 8, 256, 1024
SEED = 6
#: Vectors of a bucket whose pairs are compared at once; larger ones are compared by groups.
CROWD = 512
#: Bits of the two numbers by which a pair is compared before its vectors are.
_SKETCH = 128


def _matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    values = batch[column].flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(batch), -1) if len(batch) else values.reshape(0, 1)


class Quantiser:
    """Codes of unit vectors. Bit i is the sign of component i of (x - mean) @ turn; ``turn`` has one rotation of the principal components beside the other.

    The code is cut into ``tables`` stretches of ``key_bits`` bits each. By the pigeonhole principle, two codes that differ in fewer bits than there
    are tables agree in one stretch; ``recall`` is the part of pairs at the threshold that do, measured on ``simulated_pairs``.
    """

    def __init__(self, mean: np.ndarray, turn: np.ndarray, key_bits: int, tables: int, radius: int, recall: float) -> None:
        self.mean, self.turn, self.key_bits, self.tables, self.radius, self.recall = mean, turn, key_bits, tables, radius, recall

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn > 0

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """A key for each table: its number and its stretch of the code."""
        parts = bits[:, : self.tables * self.key_bits].reshape(len(bits), self.tables, self.key_bits)
        return parts @ (np.int64(1) << np.arange(self.key_bits, dtype=np.int64)) | np.arange(self.tables, dtype=np.int64) << np.int64(40)

    def sketch(self, bits: np.ndarray) -> np.ndarray:
        """The first bits of a code as two numbers."""
        out = np.zeros((len(bits), _SKETCH // 8), np.uint8)
        packed = np.packbits(bits[:, :_SKETCH], axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view("<i8")


def rotations(v: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` rotations of centred components ``v``, each turned from a random one to where the components are nearest to their own signs."""
    out = []
    for _ in range(count):
        turn, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        out.append(turn)
    return np.concatenate(out, axis=1)


def simulated_pairs(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and others at a cosine of ``threshold`` with them: half of them turned towards another vector of ``x``, half anywhere."""
    x = np.tile(x, (-(-4096 // len(x)), 1))[: max(4096, len(x))]
    off = x[rng.permutation(len(x))].copy()
    anywhere = np.abs(np.einsum("nd,nd->n", off, x)) > 0.999
    anywhere[::2] = True
    off[anywhere] = rng.standard_normal((anywhere.sum(), x.shape[1]))
    for _ in range(2):
        off -= np.einsum("nd,nd->n", off, x)[:, None] * x
        size = np.linalg.norm(off, axis=1, keepdims=True)
        off /= np.where(size > 1e-9, size, 1)
    there = np.linalg.norm(off, axis=1, keepdims=True) > 0.5
    return x, np.where(there, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * off, x)


def learn(sample: np.ndarray, n: int, threshold: float, bits: int = BITS, recall: float = RECALL, rounds: int = ROUNDS, seed: int = SEED) -> Quantiser:
    """The quantiser for ``n`` unit vectors, from some of them: principal components, then as many balanced rotations as the recall takes.

    Keys grow with the logarithm of n, so that a bucket of unrelated vectors stays small; the longer they are, the more tables are needed. Where
    turned rotations are too much alike for the recall (few vectors, or few components), random ones follow; then keys get shorter, in the end empty.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / len(sample))
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    key_bits = min(36, max(4, math.ceil(math.log2(max(2, n))) - 4))
    v = (centred @ axes).astype(np.float32)
    a, b = (((side - mean) @ axes).astype(np.float32) for side in simulated_pairs(sample, threshold, rng))
    turn = np.empty((axes.shape[1], 0), np.float32)
    differ = np.empty((len(a), 0), bool)
    reached = 1.0
    while True:
        if not key_bits:
            tables = 1
            break
        tables = turn.shape[1] // key_bits
        met = ~differ[:, : tables * key_bits].reshape(len(a), tables, key_bits).any(2)
        # the worse of the two kinds of pairs counts
        kinds = np.minimum(*(np.logical_or.accumulate(met[kind::2], axis=1).mean(0) for kind in (0, 1)))
        if len(enough := np.flatnonzero(kinds >= recall)):
            tables, reached = int(enough[0]) + 1, float(kinds[enough[0]])
            break
        if turn.shape[1] >= ROTATIONS * axes.shape[1]:
            key_bits -= 1
            continue
        turned = rounds if turn.shape[1] < TURNED * axes.shape[1] else 0
        more = rotations(v, max(1, turn.shape[1] // axes.shape[1] // 4), turned, rng).astype(np.float32)
        turn, differ = np.concatenate([turn, more], axis=1), np.concatenate([differ, (a @ more > 0) != (b @ more > 0)], axis=1)
    far = int(differ[:, :_SKETCH].sum(1).max())
    used = max(tables * key_bits, min(_SKETCH, turn.shape[1]))
    return Quantiser(mean, (axes @ turn[:, :used]).astype(np.float64), key_bits, tables, far + far // 4 + 2, reached)


def _close_pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The pairs a < b of one bucket whose sketches differ in at most ``radius`` bits, of (key, id, low, high) sorted by key."""
    held = np.empty((4, 0), np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, [batch[c].to_numpy() for c in ("key", "id", "low", "high")]], axis=1)
            # the last bucket may go on
            ends = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
        else:
            ends = held.shape[1]
        (key, ids, low, high), held = held[:, :ends], held[:, ends:]
        at, found = np.arange(ends), []
        for apart in range(1, ends):
            at = at[at + apart < ends]
            at = at[key[at] == key[at + apart]]
            if not len(at):
                break
            far = np.bitwise_count((low[at] ^ low[at + apart]).view(np.uint64)) + np.bitwise_count((high[at] ^ high[at + apart]).view(np.uint64)).astype(np.int64)
            near = at[far <= radius]
            found.append(np.sort([ids[near], ids[near + apart]], axis=0))
        if found:
            a, b = np.concatenate(found, axis=1)
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _units(rows: DataFrame) -> DataFrame:
    """vec_id, v (unit length) and dim of the rows that have a vector other than zero, without nulls and infinities."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["e"]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = np.flatnonzero(lengths)
            size = np.zeros(len(batch))
            with np.errstate(over="ignore", invalid="ignore"):
                if len(own):
                    size[own] = np.add.reduceat(flat * flat, (np.cumsum(lengths) - lengths)[own])
                good = np.isfinite(size) & (size > 0)
                flat = (flat / np.sqrt(np.repeat(size, lengths)))[np.repeat(good, lengths)]
            kept = lengths[good]
            ends = pa.array(np.r_[0, np.cumsum(kept)], pa.int32())
            yield pa.record_batch({"vec_id": batch["vec_id"].filter(pa.array(good)), "v": pa.ListArray.from_arrays(ends, pa.array(flat, pa.float64())), "dim": pa.array(kept, pa.int32())})

    return rows.mapInArrow(scale, "vec_id bigint, v array<double>, dim int")


def _named(units: DataFrame, n: int, dim: int, threshold: float, bits: int, recall: float, rounds: int, seed: int, sample: int) -> DataFrame:
    """vec_id and the least vec_id of its group, of ``n`` unit vectors of one length; those that nothing is near may be missing."""
    drawn = units.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / n))))
    known = drawn.orderBy("vec_id").select("v").toArrow().column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    quantiser = learn(known if len(known) > 1 else np.eye(dim), n, threshold, bits, recall, rounds, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                code = quantiser.bits(x)
                keys, sketch = quantiser.keys(code), quantiser.sketch(code)
                ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                prints = [xxhash.xxh128_digest(row.tobytes()) for row in np.round(x, 12) + 0.0]
                yield pa.record_batch({"vec_id": batch["vec_id"], "print": pa.array(prints, pa.binary()), "low": sketch[:, 0], "high": sketch[:, 1], "keys": pa.ListArray.from_arrays(ends, pa.array(keys.ravel(), pa.int64()))})

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a["low"].bitwiseXOR(b["low"])) + F.bit_count(a["high"].bitwiseXOR(b["high"])) <= quantiser.radius

    coded = cut(units.select("vec_id", "v").mapInArrow(lambda it: tidy(encode(it)), "vec_id bigint, print binary, low bigint, high bigint, keys array<bigint>"))
    firsts = coded.groupBy("print").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = cut(coded.select("print", "vec_id").join(firsts, "print").filter("first <> vec_id").select("first", "vec_id"))
    members = filter_by_ids(coded, copies.select("vec_id"), "vec_id", keep=False).select(F.col("vec_id").alias("id"), F.struct("low", "high").alias("code"), F.explode("keys").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cosine = np.einsum("nd,nd->n", _matrix(batch, "va"), _matrix(batch, "vb"))
                    yield batch.select(["a", "b"]).filter(pa.array(np.round(cosine, 9) >= threshold))

        both = pairs.join(units.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b").join(units.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a")
        return both.select("a", "b", "va", "vb").mapInArrow(rerank, "a bigint, b bigint")

    heavy = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
    light = filter_by_ids(members, heavy, "key", keep=False).select("key", "id", "code.low", "code.high").repartition("key").sortWithinPartitions("key")
    edges = verify(cut(light.mapInArrow(lambda it: tidy(_close_pairs(it, quantiser.radius)), "a bigint, b bigint").distinct()))
    if not heavy.isEmpty():
        edges = edges.union(near_groups(filter_by_ids(members, heavy, "key", keep=True), verify, near).filter("node <> component").select("node", "component"))
    groups = cut(connected_components(cut(edges), "a", "b"))
    named = copies.join(groups.withColumnRenamed("node", "first"), "first", "left").select("vec_id", F.coalesce("component", "first").alias("found"))
    return named.union(groups.select("node", "component"))


def near_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, recall: float = RECALL, rounds: int = ROUNDS, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """vec_id, group_id (the least vec_id of its group) and keep (whether vec_id is that one), for every vec_id.

    Vectors belong together when a chain of pairs joins them, each with a cosine of at least ``threshold`` and codes that meet in a table.
    Every vector is a query; no list of candidates is cut short. Equal directions are grouped before the tables.

    The index is fitted on about ``sample`` vectors (by a seeded hash of vec_id) and holds all. There are as many tables as it takes for a part of
    ``recall`` of pairs at the threshold, simulated about the sample, to meet; closer pairs meet more often. Pairs that meet are compared by
    128 bits of their codes first: those that differ in a quarter more bits than any simulated pair at the threshold aren't looked at. Buckets of up to ``CROWD``
    vectors are compared whole in one pass; in larger ones members are compared with the least one, then all that aren't in one group yet.

    * A null or empty vector, one with a null, NaN or infinite component, or zero: a group of its own. Each length of vectors has codes and tables of its own.
    * Null vec_id: left out. Repeated rows of a vec_id: the one with the least text form counts. Vectors at the threshold (to nine places) are near.
    * An empty table gives an empty result. Only vec_id and embedding are used, so further columns don't matter.
    """
    rows = one_row_per_id(embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null"), "vec_id")
    alone = rows.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("keep"))
    units = cut(_units(rows))
    lengths = sorted((r["dim"], r["count"]) for r in units.groupBy("dim").count().filter("count > 1").collect())
    if not lengths:
        return alone
    named = reduce(DataFrame.union, [_named(units.filter(F.col("dim") == dim), n, dim, threshold, bits, recall, rounds, seed, sample) for dim, n in lengths])
    return rows.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("found", "vec_id").alias("group_id"), (F.coalesce("found", "vec_id") == F.col("vec_id")).alias("keep"))


def brute_force_pairs(vectors: np.ndarray, threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """Places of all pairs with a cosine of at least ``threshold``; for tests."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 9) >= threshold, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))
