"""Document fingerprints: polynomial hashes modulo 2**61 - 1 of all prefixes; spans compare in constant time, common extensions by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.words import tidy
from amalgam.session import cut, filter_by_ids, one_row_per_id

#: The modulus, a Mersenne prime, and the base.
MODULUS = (1 << 61) - 1
BASE = 2251055966835893287
#: Characters at the beginning that documents have in common for their extensions to be looked up.
ANCHOR = 32
#: Documents that are compared with one copy of their anchor's text on average.
SALT_DOCS = 512
#: Characters by which texts are dealt to ranges before whole texts are sorted in each; their sample goes to the driver.
HEAD = 200
_M, _LOW, _29, _32, _61 = np.uint64(MODULUS), np.uint64(0xFFFFFFFF), np.uint64(29), np.uint64(32), np.uint64(61)


def mod(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo ``MODULUS``."""
    x = (x & _M) + (x >> _61)
    return np.where(x >= _M, x - _M, x)


def mul_small(a: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Products of residues and integers below 2**22, modulo ``MODULUS``."""
    high = (a >> _32) * small
    low = (a & _LOW) * small
    # high * 2**32 modulo 2**61 - 1: its bits above 29 wrap around
    return mod(mod(((high & np.uint64((1 << 29) - 1)) << _32) + (high >> _29)) + low)


class Powers:
    """Powers of the base, as many as were asked for so far."""

    def __init__(self) -> None:
        self.values = np.array([1], np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.values):
            out, x = [int(self.values[-1])], int(self.values[-1])
            for _ in range(max(n, 2 * len(self.values)) - len(self.values)):
                x = x * BASE % MODULUS
                out.append(x)
            self.values = np.concatenate([self.values, np.array(out[1:], np.uint64)])
        return self.values[:n]


class PrefixHashes:
    """``sums[i]`` is the hash of the first i characters: the sum of (code point + 1) * BASE**place."""

    def __init__(self, text: str, powers: Powers) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.powers = powers(self.n + 1)
        terms = mul_small(self.powers[: self.n], points)
        self.sums = np.zeros(self.n + 1, np.uint64)
        # halves add up without overflow for texts of up to 2**31 characters
        high, low = mod(np.cumsum(terms >> _32)), np.cumsum(terms & _LOW)
        self.sums[1:] = mod(mod(((high & np.uint64((1 << 29) - 1)) << _32) + (high >> _29)) + mod(low))

    def fingerprint(self) -> int:
        return int(self.sums[-1])

    def span(self, start: int, end: int) -> int:
        """The hash of text[start:end], times BASE**start."""
        return (int(self.sums[end]) - int(self.sums[start])) % MODULUS


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether a[i:i + length] and b[j:j + length] are equal (a false yes has a chance of length / 2**61)."""
    if min(i, j, length) < 0 or i + length > a.n or j + length > b.n:
        return False
    x, y = a.span(i, i + length), b.span(j, j + length)
    return x * int(b.powers[j - i] if j > i else 1) % MODULUS == y * int(a.powers[i - j] if i > j else 1) % MODULUS


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def common_extension_back(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common suffix of a[:i] and b[:j]."""
    low, high = 0, min(i, j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i - mid, b, j - mid, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _fingerprints(batches: Iterator[pa.RecordBatch], anchor: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        lengths, prints, heads = [], [], []
        for text in batch["text"].to_pylist():
            hashes = PrefixHashes(text, powers)
            lengths.append(hashes.n), prints.append(hashes.fingerprint()), heads.append(int(hashes.sums[anchor]) if hashes.n >= anchor else None)
        yield pa.record_batch({"doc_id": batch["doc_id"], "print": batch["print"], "n_chars": pa.array(lengths, pa.int64()), "fingerprint": pa.array(prints, pa.int64()), "head": pa.array(heads, pa.int64())})


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, last, hashes = Powers(), None, None
    for batch in batches:
        ahead, behind = [], []
        for first, text, other in zip(batch["anchor_id"].to_pylist(), batch["text"].to_pylist(), batch["other"].to_pylist(), strict=True):
            if first != last:
                last, hashes = first, PrefixHashes(other, powers)
            own = PrefixHashes(text, powers)
            ahead.append(n := common_extension(own, 0, hashes, 0))
            behind.append(min(common_extension_back(own, own.n, hashes, hashes.n), min(own.n, hashes.n) - n))
        yield pa.record_batch({"doc_id": batch["doc_id"], "anchor_id": batch["anchor_id"], "common_prefix": pa.array(ahead, pa.int64()), "common_suffix": pa.array(behind, pa.int64())})


def fingerprint_documents(docs: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_chars, fingerprint, copy_of, anchor_id, common_prefix and common_suffix, one row for each doc_id.

    ``copy_of`` is the least doc_id with the same length, fingerprint and MD5. Of texts that differ, those that begin with the same ``anchor``
    characters (an equal span) are compared with the one of the least doc_id, ``anchor_id``: how many characters the two have in common
    from the beginning, and how many at the end of what remains. The three are null for that document itself, for copies and where no other begins alike.
    Another document may agree for longer, or only at the end: ``longest_extensions`` finds that. Where many documents begin alike, their anchor's text goes
    to as many tasks as they need.

    * Null text: n_chars and all after it are null. Empty text: length 0 and fingerprint 0. Null doc_id: left out.
    * Fewer than ``anchor`` characters: no anchor. Repeated rows of a doc_id: one row; the one with the least text counts. Ties have the least doc_id.
    * An empty table gives an empty result. Whole texts at any length. Only doc_id and text are used, so further columns don't matter.
    """
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null"), "doc_id")
    known = docs.filter("text is not null")
    prints = cut(known.withColumn("print", F.unhex(F.md5("text"))).mapInArrow(lambda it: tidy(_fingerprints(it, anchor)), "doc_id bigint, print binary, n_chars bigint, fingerprint bigint, head bigint"))
    same = ["n_chars", "fingerprint", "print"]
    firsts = prints.groupBy(*same).agg(F.min("doc_id").alias("copy_of"), F.min("head").alias("head"))
    anchors = firsts.filter("head is not null").groupBy("head").agg(F.min("copy_of").alias("anchor_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("head", "anchor_id", F.ceil(F.col("n") / SALT_DOCS).alias("salts"))
    pairs = cut(firsts.join(anchors, "head").filter("copy_of <> anchor_id").select(F.col("copy_of").alias("doc_id"), "anchor_id", "salts", F.pmod(F.xxhash64("copy_of"), "salts").alias("salt")))
    leads = cut(pairs.groupBy("anchor_id").agg(F.max("salts").alias("salts")))
    texts = filter_by_ids(known, cut(pairs.select("doc_id")), "doc_id", keep=True)
    other = filter_by_ids(known, leads.select(F.col("anchor_id").alias("doc_id")), "doc_id", keep=True).select(F.col("doc_id").alias("anchor_id"), F.col("text").alias("other"))
    other = other.join(leads, "anchor_id").select("anchor_id", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    found = texts.join(pairs, "doc_id").select("doc_id", "text", "anchor_id", "salt").join(other, ["anchor_id", "salt"]).select("doc_id", "anchor_id", "text", "other")
    found = found.mapInArrow(lambda it: tidy(_extensions(it)), "doc_id bigint, anchor_id bigint, common_prefix bigint, common_suffix bigint")
    named = prints.join(firsts.drop("head"), same).select("doc_id", "n_chars", "fingerprint", "copy_of")
    return docs.select("doc_id").join(named, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", "n_chars", "fingerprint", "copy_of", "anchor_id", "common_prefix", "common_suffix")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a sorted range the least doc_id of its text (``lead``); for the first row of a text also the text before it (``other``) and what they share."""
    part, place = TaskContext.get().partitionId(), 0
    lead = last = points = None
    for batch in batches:
        leads, others, extents, places = [], [], [], []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            other = extent = None
            if text != last:
                own = _points(text)
                if lead is not None:
                    other, extent = lead, _agree(own, points)
                lead, last, points, place = doc_id, text, own, place + 1
            leads.append(lead), others.append(other), extents.append(extent), places.append(place)
        columns = {"lead": leads, "other": others, "extent": extents, "place": places, "part": [part] * len(leads)}
        yield pa.record_batch({"doc_id": batch["doc_id"]} | {name: pa.array(values, pa.int64()) for name, values in columns.items()})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        extents = [_agree(_points(a), _points(b)) for a, b in zip(batch["text"].to_pylist(), batch["before"].to_pylist(), strict=True)]
        yield pa.record_batch({"lead": batch["lead"], "other": batch["other"], "extent": pa.array(extents, pa.int64())})


def _longest_prefixes(known: DataFrame, name: str) -> DataFrame:
    """doc_id, ``name``_id and longest_``name`` of (doc_id, text): sorted texts have the most in common with one of the two beside them."""
    ranged = known.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange("head").select("doc_id", "text").sortWithinPartitions("text", "doc_id")
    rows = cut(ranged.mapInArrow(_neighbours, "doc_id bigint, lead bigint, other bigint, extent bigint, place bigint, part bigint"))
    ends = rows.groupBy("part").agg(F.min_by("lead", "place").alias("first"), F.max_by("lead", "place").alias("last")).orderBy("part").collect()
    edges = cut(known.sparkSession.createDataFrame([(b["first"], a["last"]) for a, b in zip(ends, ends[1:], strict=False)], "lead bigint, other bigint"))
    texts = filter_by_ids(known, cut(edges.select(F.col("lead").alias("doc_id")).distinct()), "doc_id", keep=True).withColumnRenamed("doc_id", "lead")
    before = filter_by_ids(known, cut(edges.select(F.col("other").alias("doc_id")).distinct()), "doc_id", keep=True).select(F.col("doc_id").alias("other"), F.col("text").alias("before"))
    across = edges.join(texts, "lead").join(before, "other").select("lead", "other", "text", "before").mapInArrow(_compare, "lead bigint, other bigint, extent bigint")
    pairs = rows.filter("other is not null").select("lead", "other", "extent").union(across).filter("extent > 0")
    both = pairs.union(pairs.select(F.col("other").alias("lead"), F.col("lead").alias("other"), "extent"))
    best = both.groupBy("lead").agg(F.max(F.struct("extent", (-F.col("other")).alias("least"))).alias("best"))
    return rows.join(best, "lead", "left").select("doc_id", (-F.col("best.least")).alias(f"{name}_id"), F.coalesce("best.extent", F.lit(0)).cast("bigint").alias(f"longest_{name}"))


def longest_extensions(docs: DataFrame) -> DataFrame:
    """doc_id, prefix_id, longest_prefix, suffix_id and longest_suffix, one row for each doc_id.

    ``longest_prefix`` is the most characters that a document has in common, from the beginning, with any document of another text, exactly;
    ``prefix_id`` is one that has them (the text before or after it in order, of equals the least doc_id). The same from the end, by reversed texts.
    Texts are sorted whole in ranges of their first ``HEAD`` characters; those that agree in all of these are in one range, whose sort spills.
    Spans in the middle of two texts that agree neither at the beginning nor at the end aren't looked for.

    * Null text: all null. Nothing in common with any other, empty text or no other text: length 0 and a null id. Null doc_id: left out.
    * Copies of a text have the same result; of their own doc_ids the least stands for them. Repeated rows of a doc_id: as in ``fingerprint_documents``.
    * An empty table gives an empty result. Only doc_id and text are used, so further columns don't matter.
    """
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null"), "doc_id")
    known = docs.filter("text is not null")
    found = _longest_prefixes(known, "prefix").join(_longest_prefixes(known.withColumn("text", F.reverse("text")), "suffix"), "doc_id")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", "prefix_id", "longest_prefix", "suffix_id", "longest_suffix")
