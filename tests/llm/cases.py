"""Tables with every odd case, and brute-force versions of operators."""

import random
import re

WORDS = "the of and river stone house green walk under light paper seven cloud table wind glass north early open field music round small tree".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an operator could use itself.
CLASHING = ("key", "keys", "id", "h", "n", "rank__", "n__", "starts__", "ends__", "group_id", "row__")


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(rng.randrange(9))]) for _ in range(n))


def table(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark, rng=None):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, ties, and further columns with clashing names."""
    from pyspark.sql import functions as F

    rng = rng or random.Random(1)
    long = words(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ..."), (5, long), (6, words(rng, 60)), (6, words(rng, 60)), (None, words(rng, 70)), (7, words(rng, 55), None, None), (8, "a"), (9, "a"), (10, "\x00😀 é".encode("utf-16", "surrogatepass").decode("utf-16"))]
    df = table(spark, rows)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return table(spark, [])


def own_columns_stay(df):
    for name in CLASHING:
        if name in df.columns:
            assert {r[name] for r in df.select(name).distinct().collect()} <= {f"own {name}"}


def shingle_set(text, size=3):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups_of(ids, edges):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
