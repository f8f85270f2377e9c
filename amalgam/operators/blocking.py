"""Candidate pairs: blockers emit keys, records that share a key are paired by an equi-join on it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.functions import ids
from amalgam.functions import keys as K
from amalgam.functions import text as X
from amalgam.operators import units
from amalgam.session import cut, one_row_per_id

PERMUTATIONS, BANDS, MINHASH_TOKENS, MINHASH_SEED = 128, 16, 3, 42
SIMHASH_BITS, SIMHASH_CHUNKS, SIMHASH_TOKENS = 64, 4, 5
PREFIX, YEARS = 32, (-1, 0, 1)
RARE_TOKENS, RARE_SHARE = 3, 0.01
#: A block of more records is reported; none is dropped. The largest of them that a run's report lists by name.
LARGE_BLOCK, LISTED_BLOCKS = 1000, 100
_PRIME = (1 << 31) - 1
try:
    from _sha2 import sha256 as _sha256  # the same digests, with less to set up for each
except ImportError:
    _sha256 = hashlib.sha256
#: Tokens that are worked on at once (as many as stay in a core's cache), and records whose distinct tokens are looked for at once.
_CHUNK, _RECORDS = 512, 256


class Blocker:
    """A source of keys. ``keys`` takes records (rid, canon, keys, flags) and returns rid and block_key; nulls are no keys."""

    name = ""
    match_key = ""

    def column(self) -> Column:
        """An array of keys, or null."""
        raise NotImplementedError

    def keys(self, records: DataFrame) -> DataFrame:
        return records.select("rid", F.explode(self.column()).alias("block_key")).filter("block_key is not null and block_key <> ''")


def _title_tokens() -> Column:
    # each field is named once, so that only what is asked for of keys and flags is computed
    none = F.array().cast("array<string>")
    plain = lambda shingles: F.when(F.size(shingles) > 0, shingles).otherwise(F.coalesce(K.long_tokens(F.col("canon.title_norm_basic")), none))
    return F.when(F.coalesce(F.col("flags.title_missing"), F.lit(False)), none).otherwise(X.let(F.col("keys.title_shingles"), plain))


class DoiBlocker(Blocker):
    name, match_key = "doi_exact", "doi_norm"

    def column(self) -> Column:
        return F.array("canon.doi_norm")


class PmidBlocker(Blocker):
    name, match_key = "pmid_exact", "pmid_norm"

    def column(self) -> Column:
        return F.array("canon.pmid_norm")


def minhash_factors(permutations: int = PERMUTATIONS, seed: int = MINHASH_SEED) -> list[tuple[int, int]]:
    """a and b of each permutation."""
    return [tuple(x) for x in np.random.default_rng(seed).integers(1, _PRIME, (permutations, 2)).tolist()]


def _digests(tokens: pa.Array, salt: str, digits: int) -> np.ndarray:
    """The first ``digits`` hexadecimal digits of the SHA-256 of ``salt`` and each token, as numbers; read from Arrow's bytes, without Python strings."""
    tokens = tokens.cast(pa.large_binary())
    _, places, data = tokens.buffers()
    ends = np.frombuffer(places, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1].tolist()
    held, front = b"" if data is None else data.to_pybytes(), salt.encode()
    found = b"".join([_sha256(front + held[i:j]).digest()[:8] for i, j in zip(ends, ends[1:], strict=False)])
    return np.frombuffer(found, ">u8").astype(np.uint64) >> np.uint64(64 - 4 * digits)


def _key_rows(tokens: DataFrame, min_tokens: int, salt: str, digits: int, reduce_rows, keys_of) -> DataFrame:  # noqa: ANN001
    """rid and block_key of (rid, tokens) in one Arrow pass: no shuffle, and the tokens are computed once.

    ``reduce_rows`` takes token numbers and the first place of each record; its results are combined over chunks, so that a long record takes no more
    memory than a short one. ``keys_of`` takes a record's result and its number of tokens.
    """

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, keys = [], []
            for at in range(0, len(batch), _RECORDS):
                part = batch.slice(at, _RECORDS)
                part = part.filter(pc.fill_null(pc.greater_equal(pc.list_value_length(part["tokens"]), max(1, min_tokens)), False))
                if len(part):
                    counts = pc.list_value_length(part["tokens"]).to_numpy().astype(np.int64)
                    coded = part["tokens"].flatten().dictionary_encode()
                    flat = _digests(coded.dictionary, salt, digits)[coded.indices.to_numpy()]
                    for rid, n, found in zip(part["rid"].to_pylist(), counts.tolist(), reduce_rows(flat, np.cumsum(counts) - counts), strict=True):
                        own = keys_of(found, n)
                        keys += own
                        rids += [rid] * len(own)
            yield pa.record_batch({"rid": pa.array(rids, pa.string()), "block_key": pa.array(keys, pa.string())})

    return tokens.select(F.col("rid").cast("string").alias("rid"), "tokens").mapInArrow(pass_over, "rid string, block_key string")


def _by_record(flat: np.ndarray, starts: np.ndarray, width: int, values, combine: np.ufunc, none: int, dtype: type) -> np.ndarray:  # noqa: ANN001
    """``combine`` over the rows of ``values`` (a matrix of ``width`` columns for some numbers) of each record, in chunks."""
    out = np.full((len(starts), width), none, dtype)
    for low in range(0, len(flat), _CHUNK):
        high = min(len(flat), low + _CHUNK)
        first = int(np.searchsorted(starts, low, "right")) - 1
        inside = np.r_[low, starts[(starts > low) & (starts < high)]]
        owners = slice(first, first + len(inside))
        out[owners] = combine(out[owners], combine.reduceat(values(flat[low:high]), inside - low, axis=0, dtype=dtype))
    return out


def minhash_bands(tokens: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, seed: int = MINHASH_SEED, min_tokens: int = 1) -> DataFrame:
    """rid and one key for each band of the MinHash signature of (rid, tokens) with enough tokens: (a * x + b) mod p over 28 bits of each token's SHA-256."""
    rows = permutations // bands
    a, b = (np.array(x, np.uint64) for x in zip(*minhash_factors(permutations, seed), strict=True))
    prime, shift = np.uint64(_PRIME), np.uint64(31)

    def permuted(x: np.ndarray) -> np.ndarray:
        # the prime is 2**31 - 1 and x below 2**28, so that one fold leaves less than twice the prime; below the prime, the difference wraps and is the greater one
        v = x[:, None] * a
        v += b
        high = v >> shift
        v &= prime
        v += high
        low = v.astype(np.uint32)
        return np.minimum(low, low - np.uint32(_PRIME))

    def keys_of(signature: np.ndarray, n: int) -> list[str]:
        own = [str(x) for x in signature.tolist()]
        return [f"mh:b{i}:{hashlib.sha256(','.join(own[i * rows : (i + 1) * rows]).encode()).hexdigest()[:16]}" for i in range(bands)]

    return _key_rows(tokens, min_tokens, "", 7, lambda flat, starts: _by_record(flat, starts, permutations, permuted, np.minimum, _PRIME, np.uint32), keys_of)


class MinHashBlocker(Blocker):
    name, match_key = "minhash_lsh_title_v1", "title_shingles"

    def __init__(self, num_perm: int = PERMUTATIONS, bands: int = BANDS, min_tokens: int = MINHASH_TOKENS) -> None:
        self.num_perm, self.bands, self.min_tokens = num_perm, bands, min_tokens

    def keys(self, records: DataFrame) -> DataFrame:
        return minhash_bands(records.select("rid", _title_tokens().alias("tokens")), self.num_perm, self.bands, min_tokens=self.min_tokens)


def simhash_chunks(tokens: DataFrame, bits: int = SIMHASH_BITS, chunks: int = SIMHASH_CHUNKS, min_tokens: int = 1) -> DataFrame:
    """rid and keys of the stretches of the SimHash of (rid, tokens) with enough tokens, the lowest first; a token's hash is the beginning of its SHA-256, which has 0: in front.

    Tokens vote as often as they occur; a bit is set if more than half of the votes are for it.
    """
    digits = bits // chunks // 4
    width = 4 * digits * chunks

    def votes(x: np.ndarray) -> np.ndarray:
        return np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]

    def keys_of(found: np.ndarray, n: int) -> list[str]:
        text = np.packbits(2 * found > n).tobytes().hex()
        return [f"sh:c{i}:{text[(chunks - 1 - i) * digits : (chunks - i) * digits]}" for i in range(chunks)]

    return _key_rows(tokens, min_tokens, "0:", width // 4, lambda flat, starts: _by_record(flat, starts, width, votes, np.add, 0, np.int64), keys_of)


class SimHashBlocker(Blocker):
    name, match_key = "simhash_title_v1", "title_norm_basic"

    def __init__(self, min_tokens: int = SIMHASH_TOKENS, chunks: int = SIMHASH_CHUNKS, bits: int = SIMHASH_BITS) -> None:
        self.bits, self.chunks, self.min_tokens = bits, chunks, min_tokens

    def keys(self, records: DataFrame) -> DataFrame:
        return simhash_chunks(records.select("rid", _title_tokens().alias("tokens")), self.bits, self.chunks, self.min_tokens)


def year_keys(year: Column, rest: Column) -> Column:
    """``y<year>:<rest>`` for the year and its neighbours, so that an equi-join finds years that are near."""
    return F.when(year.isNotNull() & (rest != ""), F.transform(F.array(*map(F.lit, YEARS)), lambda d: F.concat(F.lit("y"), (year + d).cast("string"), F.lit(":"), rest)))


class YearAuthorBlocker(Blocker):
    name, match_key = "bib_year_pm1_first_author_v1", "year_first_author"

    def column(self) -> Column:
        return year_keys(F.col("canon.year_norm"), F.col("canon.first_author_sig"))


class YearTitleBlocker(Blocker):
    name, match_key = "bib_year_pm1_title_prefix_v1", "year_title_prefix"

    def __init__(self, prefix_len: int = PREFIX) -> None:
        self.prefix_len = prefix_len

    def column(self) -> Column:
        title = F.col("keys.title_key_strict")
        return year_keys(F.col("canon.year_norm"), F.when(title != "", F.concat(F.lit("tp"), F.substring(title, 1, self.prefix_len))))


def rare_tokens(tokens: DataFrame, k: int = RARE_TOKENS, share: float = RARE_SHARE) -> DataFrame:
    """rid and token: the ``k`` rarest tokens of each (rid, tokens) that occur in at most ``share`` of all rows with tokens.

    Of equally rare ones the first in the list; a repeated token takes a place for each time, as it isn't taken out of the list before.
    The tokens are computed once; frequencies are combined before their shuffle, and only rare tokens are joined back.
    """
    there = one_row_per_id(cut(tokens.select("rid", F.when(F.size("tokens") > 0, F.col("tokens")).alias("tokens"))), "rid")
    limit = math.floor(there.agg(F.count("tokens")).first()[0] * share)
    counts = there.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= limit)
    placed = there.select("rid", F.posexplode("tokens").alias("pos", "token"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("df", "pos"))
    return placed.join(counts.hint("merge"), "token").withColumn("rank", rank).filter(F.col("rank") <= k).select("rid", "token").distinct()


class RareTokensBlocker(Blocker):
    name, match_key = "bib_rare_title_tokens_v1", "rare_tokens"

    def __init__(self, k: int = RARE_TOKENS, df_max_ratio: float = RARE_SHARE) -> None:
        self.k, self.df_max_ratio = k, df_max_ratio

    def keys(self, records: DataFrame) -> DataFrame:
        found = rare_tokens(records.select("rid", _title_tokens().alias("tokens")), self.k, self.df_max_ratio)
        return found.select("rid", F.concat(F.lit("rt:"), "token").alias("block_key"))


REGISTRY: dict[str, type[Blocker]] = {
    "doi": DoiBlocker, "pmid": PmidBlocker, "minhash": MinHashBlocker, "simhash": SimHashBlocker,
    "year_author": YearAuthorBlocker, "year_title": YearTitleBlocker, "rare_tokens": RareTokensBlocker,
}


@dataclass(frozen=True)
class BlockerConfig:
    type: str
    enabled: bool = True
    params: dict[str, object] = field(default_factory=dict)


def create_blocker(spec: BlockerConfig) -> Blocker:
    if spec.type not in REGISTRY:
        raise ValueError(f"unknown blocker {spec.type!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[spec.type](**spec.params)


def create_blockers(configs: Iterable[BlockerConfig]) -> list[Blocker]:
    return [create_blocker(c) for c in configs if c.enabled]


def block_pairs(keys: DataFrame) -> DataFrame:
    """rid_a < rid_b and the least key of each pair of records that share one.

    Records with the same keys are joined as units, blocks of very many pairs in cells, and no pair is shuffled: each comes out once, at its least key.
    """
    found = units.make_units(units.keys_by_record(keys), ("found",))
    return units.list_pairs(units.unit_pairs(found, listed=True), F.col("key").alias("block_key")).select("rid_a", "rid_b", "block_key")


def _pairs_of_one_blocker(keys: DataFrame) -> DataFrame:
    """As ``block_pairs``, for records that have many keys each and few in common."""
    keys = keys.select("rid", "block_key").distinct()
    a, b = keys.withColumnRenamed("rid", "rid_a"), keys.withColumnRenamed("rid", "rid_b")
    return a.join(b, "block_key").filter("rid_a < rid_b").groupBy("rid_a", "rid_b").agg(F.min("block_key").alias("block_key"))


def generate_candidates(records: DataFrame, blockers: Iterable[Blocker]) -> DataFrame:
    """``schema.PAIRS``: every pair once, with one source for each blocker that found it, by blocker name."""
    # repeated rids are one record; rows without a rid can't be paired
    records = records.select("rid", "canon", "keys", "flags").filter("rid is not null")
    parts = [_pairs_of_one_blocker(b.keys(records)).select("rid_a", "rid_b", F.struct(F.lit(b.name).alias("blocker"), "block_key", F.lit(b.match_key).alias("match_key")).alias("source")) for b in blockers]
    if not parts:
        return records.sparkSession.createDataFrame([], "pair_id string, rid_a string, rid_b string, sources array<struct<blocker:string,block_key:string,match_key:string>>")
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("rid_a", "rid_b").agg(F.array_sort(F.collect_list("source")).alias("sources")).select(ids.pair_id(F.col("rid_a"), F.col("rid_b")).alias("pair_id"), "rid_a", "rid_b", "sources")


def large_blocks(keys: DataFrame, limit: int = LARGE_BLOCK) -> DataFrame:
    """block_key and block_size of the blocks of more than ``limit`` records, the largest first."""
    sizes = keys.select("rid", "block_key").distinct().groupBy("block_key").agg(F.count(F.lit(1)).alias("block_size"))
    return sizes.filter(F.col("block_size") > limit).orderBy(F.desc("block_size"), "block_key")


def block_statistics(keys: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records_seen, records_keyed, unique_keys, blocks_gt1, pairs_raw, max_block and large_blocks of one blocker's (rid, block_key)."""
    sizes = keys.select("rid", "block_key").distinct().groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.agg(
        F.count(F.lit(1)).alias("unique_keys"),
        F.count_if(F.col("n") > 1).alias("blocks_gt1"),
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs_raw"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_block"),
        F.count_if(F.col("n") > LARGE_BLOCK).alias("large_blocks"),
    )
    seen = records.agg(F.count(F.lit(1)).alias("records_seen"))
    keyed = keys.agg(F.count_distinct("rid").alias("records_keyed"))
    # three single rows
    return seen.crossJoin(keyed).crossJoin(blocks)
