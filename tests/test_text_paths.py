"""Texts that don't go through Python give what Python gives, and those that do go in pieces."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from amalgam.functions import text as X
from amalgam.operators import blocking as B


def all_forms(t):
    return X.fold_text(t, False), X.fold_text(t, True), X.unaccented(t.casefold()), X.unaccented(t)


def test_every_usual_character_alone_and_among_others(spark):
    texts = [t for c in X._COMMON for t in (c, f"A{c}b {c}{c}Eß", f"x{c}́y", f"{c}中")] + ["", "Plain TEXT", "ÉCOLE Straße İx ﬁ …", "".join(X._COMMON)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    for r in df.select("t", X.fold(t).alias("a"), X.fold_keeping_accents(t).alias("b"), X.fold_name(t).alias("c"), X.strip_accents(t).alias("d")).collect():
        assert (r["a"], r["b"], r["c"], r["d"]) == all_forms(r["t"]), repr(r["t"])


def test_latin_texts_stay_in_the_jvm(spark):
    """The Python function would be called with the text; it gets nulls only."""
    pattern, mapped = X._latin(lambda t: X.fold_text(t, False))
    df = spark.createDataFrame([("Été à la Straße Ñ",), ("中",), ("é",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(pattern)).collect()] == [True, False, False]
    assert df.select(F.lower(mapped(F.col("t")))).first()[0] == "ete a la strasse n"


def test_python_strings_of_a_batch_are_few_at_once(monkeypatch):
    seen = []
    monkeypatch.setattr(X.F, "arrow_udf", lambda function, kind: function)
    apply = X._arrow(lambda t: t.upper())
    whole = pa.array([None, *"é" * 1000], pa.string())
    monkeypatch.setattr(X, "_ROWS", 100)
    monkeypatch.setattr(X.pa, "array", lambda values, kind, real=pa.array: seen.append(len(values)) or real(values, kind))
    assert apply(whole).to_pylist() == [None, *"É" * 1000] and max(seen) == 100


@pytest.mark.parametrize("chunk", [3, 512])
def test_keys_of_repeated_tokens_in_any_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "_CHUNK", chunk)
    lists = [["a", "b", "a", "c", "d"], ["x"], None, [], [f"t{i % 700}" for i in range(1500)]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(lists)], "rid string, tokens array<string>")
    factors, prime = B.minhash_factors(), (1 << 31) - 1
    want = set()
    for i, tokens in enumerate(lists):
        xs = [int(hashlib.sha256(t.encode()).hexdigest()[:7], 16) for t in tokens or []]
        if xs:
            signature = [str(min((a * x + b) % prime for x in xs)) for a, b in factors]
            want |= {(str(i), f"mh:b{k}:{hashlib.sha256(','.join(signature[8 * k : 8 * k + 8]).encode()).hexdigest()[:16]}") for k in range(16)}
    assert {tuple(r) for r in B.minhash_bands(df).collect()} == want


def test_the_greatest_and_least_hashes_are_reduced(spark):
    a, b = (np.array(x, np.uint64) for x in zip(*B.minhash_factors(), strict=True))
    for x in (0, 1, (1 << 28) - 1):
        v = x * a + b
        assert int(((v & np.uint64(B._PRIME)) + (v >> np.uint64(31))).max()) < 2 * B._PRIME


def test_digests_are_read_from_any_slice():
    tokens = pa.array(["zero", "", "é ü", "a" * 300, "last"])
    want = lambda salt, n, part: [int(hashlib.sha256((salt + t).encode()).hexdigest()[:n], 16) for t in part.to_pylist()]
    for part in (tokens, tokens.slice(1, 3), tokens.slice(2), pa.array([""]), tokens.slice(0, 0)):
        assert B._digests(part, "0:", 16).tolist() == want("0:", 16, part) and B._digests(part, "", 7).tolist() == want("", 7, part)
