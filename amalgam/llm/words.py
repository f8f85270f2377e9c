"""Words of a text and their hashes, for operators that work on word sequences."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Texts whose words are hashed at once.
SLICE = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: By byte: whether it is part of a token, of one as Java's ``\S+`` has it, and of an ASCII word.
_TOKEN_BYTES, _COUNTED_BYTES, _WORD_BYTES = (np.array([bool(re.fullmatch(p, chr(b))) for b in range(256)]) for p in (r"[^ \t\n\r\f]", r"[^ \t\n\r\f\v]", r"(?a:\w)"))


@functools.cache
def _word_points() -> np.ndarray:
    """By code point: whether it is part of a word."""
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer(np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


def xxh64(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The XXH64 of each stretch of bytes, as ``xxhash.xxh64_intdigest`` has it, all at once."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    size = stops - starts
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eights, fours = (np.ndarray(len(data) - w + 1, f"<u{w}", data, strides=(1,)) for w in (8, 4))
    h = size.astype(np.uint64) + _P5
    for lane in range(3):
        own = np.flatnonzero(size >= 8 * lane + 8)
        x = turned(eights[starts[own] + 8 * lane] * _P2, 31) * _P1
        h[own] = turned(h[own] ^ x, 27) * _P1 + _P4
    own = np.flatnonzero(size & 4)
    x = fours[starts[own] + (size[own] & ~7)].astype(np.uint64) * _P1
    h[own] = turned(h[own] ^ x, 23) * _P2 + _P3
    for k in range(3):
        own = np.flatnonzero(size & 3 > k)
        h[own] = turned(h[own] ^ (data[starts[own] + (size[own] & ~3) + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes())
    return h


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    change = np.concatenate([[0] if len(inside) and inside[0] else [], change, [len(inside)] if len(inside) and inside[-1] else []]).astype(np.int64)
    return change[::2], change[1::2]


def _each(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of each text, of which the last ends at ``ends``."""
    at = np.r_[0, np.searchsorted(starts, ends)]
    return (hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its words (``WORD``) in lower case (XXH64 of their UTF-8 bytes); of a null none."""
    for at in range(0, len(texts), SLICE):
        own = [(t or "").lower() for t in texts[at : at + SLICE].to_pylist()]
        ends = np.cumsum([len(t) + 1 for t in own])
        joined = "\n".join([*own, ""])
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) == len(joined):
            starts, stops = _runs(_WORD_BYTES[data])
            yield from _each(xxh64(data, starts, stops), starts, ends)
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            starts, stops = _runs(_word_points()[points])
            place = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))
            place = np.concatenate([[0], place])
            yield from _each(xxh64(data, place[starts], place[stops]), starts, ends)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a blank after each, and where each one ends with its blank. A null is an empty text."""
    blank, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(nothing), nothing, blank)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def token_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of characters other than ASCII whitespace (space, tab, line feed, carriage return, form feed); of a null none."""
    for at in range(0, len(texts), SLICE):
        data, ends = _utf8(texts[at : at + SLICE])
        starts, stops = _runs(_TOKEN_BYTES[data])
        yield from _each(xxh64(data, starts, stops), starts, ends)


def _counted(texts: pa.Array) -> pa.Array:
    counts = [np.empty(0, np.int64)]
    for at in range(0, len(texts), SLICE):
        data, ends = _utf8(texts[at : at + SLICE])
        starts, _ = _runs(_COUNTED_BYTES[data])
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
    return pc.if_else(texts.is_valid(), pa.array(np.concatenate(counts)), pa.scalar(None, pa.int64()))


def count_tokens(text: Column) -> Column:
    r"""What ``regexp_count(text, '\S+')`` is, without the cost of a regular expression in the JVM: its whitespace is ASCII's, vertical tab included."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(map(_counted, batches))

    return counted(text)


def tidy[T](batches: Iterator[T]) -> Iterator[T]:
    """``batches``; after the last one, memory that the task freed goes back to the system, as workers live on while others need it."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
