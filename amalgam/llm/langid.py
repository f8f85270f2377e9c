"""Language identification with hyperdimensional profiles: permuted random letter vectors bound into n-grams and bundled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.words import tidy

#: Components of a vector.
DIM = 1024
SEED = 4
#: n-gram vectors that a worker keeps; beyond that it starts afresh. Groups in which a language's partial sums are added up.
KEPT, FAN_IN = 40_000, 16
_SPACE = 32
_BITS = 21

SCHEMA = "doc_id bigint, lang_pred string, score double, margin double"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_codes(text: str | None) -> np.ndarray:
    """The letter trigrams of a text as integers; letters are lower-cased, every run of others is one space, with one at both ends."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c = np.where(letter, points, _SPACE)[keep].astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    return (c[:-2] << (2 * _BITS)) | (c[1:-1] << _BITS) | c[2:]


def letter_vector(point: int, dim: int, seed: int) -> np.ndarray:
    """The random vector of plus and minus ones of a letter; it depends on the letter, ``dim`` and ``seed`` alone."""
    return np.random.default_rng((seed, point)).integers(0, 2, dim, np.int8).astype(np.float32) * 2 - 1


class Ngrams:
    """Vectors of trigrams: the letter vectors, shifted by 2, 1 and 0 places, multiplied."""

    def __init__(self, dim: int, seed: int) -> None:
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((256, self.dim), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if (v := self.letters.get(point)) is None:
            if len(self.letters) > KEPT:
                self.letters.clear()
            v = self.letters[point] = letter_vector(point, self.dim, self.seed)
        return v

    def bundle(self, codes: np.ndarray, counts: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """The sum of the vectors of distinct ``codes``, each times its count; exact while sums of counts fit in ``kind``."""
        total = np.zeros(self.dim, np.float64)
        for at in range(0, len(codes), 4096):
            rows = self._find(codes[at : at + 4096])
            total += counts[at : at + 4096].astype(kind) @ self.vectors[rows].astype(kind, copy=False)
        return total

    def _find(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(codes) > KEPT:
            self.clear()
        rows, mask = self.rows, (1 << _BITS) - 1
        found = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            if (at := rows.get(code)) is None:
                at = rows[code] = len(rows)
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                a, b, c = code >> (2 * _BITS), (code >> _BITS) & mask, code & mask
                self.vectors[at] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            found[i] = at
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, added up over a task as far as they fit in memory."""
    totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in totals.items():
            codes, counts = merged(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": counts})

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if len(codes := ngram_codes(text)):
                parts = totals.setdefault(lang, [])
                parts.append(np.unique(codes, return_counts=True))
                if len(parts) > 512:
                    totals[lang] = [merged(parts)]
        if sum(len(c) for parts in totals.values() for c, _ in parts) > 2_000_000:
            yield from rows()
            totals.clear()
    yield from rows()


def train_profiles(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit length), from every document that has a language and letters.

    The trigrams of a language are counted over all its documents; the prototype is the bundle of their vectors, which equals the sum of
    its documents' bundles. The vectors are added up in the tasks, then in ``FAN_IN`` groups a language, so that the driver gets as many vectors at most.

    Null or empty texts, texts without a letter and null languages count nowhere; a repeated row counts again. An empty table gives no language.
    """
    counts = (
        docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .dropna()
        .mapInArrow(lambda it: tidy(_count(it)), "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Ngrams(dim, seed), {}
        for batch in batches:
            langs, codes, n = np.asarray(batch["lang"].to_pylist(), object), batch["code"].to_numpy(), batch["n"].to_numpy()
            for lang in set(langs):
                own = langs == lang
                sums[lang] = sums.get(lang, 0) + grams.bundle(codes[own], n[own], np.float64)
        if sums:
            group = pa.array([TaskContext.get().partitionId() % FAN_IN] * len(sums), pa.int32())
            yield pa.record_batch({"lang": pa.array(list(sums), pa.string()), "g": group, "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), dim).sum(0)
        return pa.table({"lang": table["lang"][:1].cast(pa.string()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    # sums of whole numbers in doubles, so they don't depend on the order
    parts = counts.mapInArrow(bundles, "lang string, g int, v array<double>").groupBy("lang", "g").applyInArrow(added, "lang string, v array<double>").toPandas()
    langs = sorted(set(parts["lang"]))
    prototypes = np.zeros((len(langs), dim))
    for lang, v in zip(parts["lang"], parts["v"], strict=True):
        prototypes[langs.index(lang)] += np.asarray(v)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, prototypes / np.where(norms > 0, norms, 1)


def identify_languages(docs: DataFrame, profiles: tuple[list[str], np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (the cosine with the nearest prototype) and margin (to the second; the score itself if there is one language).

    * Null or empty text, text without a letter, or no profiles: lang_pred, score and margin are null.
    * Ties: the language that is first in order. Null doc_id and repeated rows: one row each.
    * Whole texts are read at any length. Only doc_id and text are used, so further columns don't matter.
    """
    langs, prototypes = profiles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Ngrams(dim, seed)
        for batch in batches:
            names, best, margin = [], [], []
            for text in batch["text"].to_pylist():
                codes = ngram_codes(text) if langs else ()
                v = grams.bundle(*np.unique(codes, return_counts=True), np.float64 if len(codes) >= 1 << 24 else np.float32) if len(codes) else None
                if v is None or not (norm := np.linalg.norm(v)):
                    names.append(None), best.append(None), margin.append(None)
                    continue
                cos = np.round(prototypes @ v / norm, 9)
                at = int(np.argmax(cos))
                rest = np.delete(cos, at)
                names.append(langs[at]), best.append(float(cos[at])), margin.append(float(cos[at] - rest.max()) if len(rest) else float(cos[at]))
            yield pa.record_batch({"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(best, pa.float64()), "margin": pa.array(margin, pa.float64())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: tidy(score(it)), SCHEMA)
