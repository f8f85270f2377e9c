"""Mixing overlapping sources to target weights: a min-cost flow from membership patterns to source quotas, then seeded selection."""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.llm.words import count_tokens
from amalgam.session import cut, one_row_per_id, unused

#: Passes over a document at most, and the cost of a token in each pass: convex, so that a further pass costs more than the last.
COSTS = (0, 1, 3, 6)
#: Default weights are shares of a source's available tokens to this power; the budget is this part of all distinct tokens.
ALPHA, BUDGET = 0.8, 1.0
SEED = 5
#: Documents of a pattern's hash range on average; each range is put in order by itself.
RANGE_DOCS = 50_000


class MixFlow:
    """Min-cost flow: source, patterns, components, sink.

    A pattern offers its tokens once at each of ``costs``, which increase; it feeds the components that it is a member of, each of which
    takes its quota. Only the passes cost anything, so the primal-dual method has one phase for each of ``costs``: the shortest augmenting
    paths of a phase are those that begin with that pass, and a blocking flow (Dinic) exhausts them.
    """

    def __init__(self, tokens: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: tuple[int, ...] = COSTS) -> None:
        n, sizes = len(tokens), np.fromiter(map(len, members), np.int64, len(members))
        self.patterns, self.costs, self.sink = n, costs, 1 + n + len(quotas)
        self.pattern = np.repeat(np.arange(n), sizes)
        self.component = np.fromiter((c for own in members for c in own), np.int64, len(self.pattern))
        # arcs from the source to patterns, to components, to the sink; each has its reverse beside it
        tails = np.r_[np.zeros(n, np.int64), 1 + self.pattern, 1 + n + np.arange(len(quotas))]
        heads = np.r_[1 + np.arange(n), 1 + n + self.component, np.full(len(quotas), self.sink)]
        room = np.r_[np.zeros(n, np.int64), np.full(len(self.pattern), sum(tokens) * len(costs), np.int64), np.asarray(quotas, np.int64)]
        ends = np.stack([heads, tails], 1).ravel()
        begins = np.stack([tails, heads], 1).ravel()
        # compact, as there may be many patterns: the arcs of node x are arcs[first[x]:first[x + 1]]
        self.to, self.room = array("q", ends.tobytes()), array("q", np.stack([room, np.zeros_like(room)], 1).tobytes())
        self.arcs = array("q", np.argsort(begins, kind="stable").tobytes())
        self.first = array("q", np.r_[0, np.cumsum(np.bincount(begins, minlength=self.sink + 1))].tobytes())
        del tails, heads, room, ends, begins
        self.cost = self.amount = 0
        for cost in costs:
            for p in range(n):
                self.room[2 * p] += tokens[p]
            moved = self._augment()
            self.amount += moved
            self.cost += cost * moved

    def _augment(self) -> int:
        to, room, arcs, first = self.to, self.room, self.arcs, self.first
        total = 0
        while True:
            level = array("q", [-1]) * (self.sink + 1)
            level[0] = 0
            queue = deque([0])
            while queue:
                x = queue.popleft()
                for k in range(first[x], first[x + 1]):
                    if room[arc := arcs[k]] and level[y := to[arc]] < 0:
                        level[y] = level[x] + 1
                        queue.append(y)
            if level[self.sink] < 0:
                return total
            at, path, x = first[:-1], [], 0
            while True:
                if x == self.sink:
                    least = min(room[arc] for arc in path)
                    for arc in path:
                        room[arc] -= least
                        room[arc ^ 1] += least
                    total += least
                    full = next(i for i, arc in enumerate(path) if not room[arc])
                    x = to[path[full] ^ 1]
                    del path[full:]
                end = first[x + 1]
                while at[x] < end and not (room[arcs[at[x]]] and level[to[arcs[at[x]]]] == level[x] + 1):
                    at[x] += 1
                if at[x] < end:
                    path.append(arcs[at[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break

    def used(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern, component and tokens of each arc in use, in order of patterns."""
        flow = np.frombuffer(self.room, np.int64)[2 * self.patterns + 1 :: 2][: len(self.pattern)]
        there = np.flatnonzero(flow)
        return self.pattern[there], self.component[there], flow[there]

    def flows(self) -> list[tuple[int, int, int]]:
        """``used`` as a list."""
        return list(zip(*(x.tolist() for x in self.used()), strict=True))


def quotas(available: dict[str, int], budget: int, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> dict[str, int]:
    """Whole tokens for each component, in proportion to ``weights`` (default: available tokens to the power ``alpha``); they add up to ``budget``."""
    share = {c: float(weights.get(c, 0.0)) if weights is not None else n**alpha for c, n in available.items()}
    total = sum(share.values())
    if not total:
        return dict.fromkeys(available, 0)
    exact = {c: budget * s / total for c, s in share.items()}
    out = {c: int(x) for c, x in exact.items()}
    for c in sorted(out, key=lambda c: (out[c] - exact[c], c))[: budget - sum(out.values())]:
        out[c] += 1
    return out


def _unit_key(docs: DataFrame) -> Column:
    """The doc_id as a string, or, where it is null, a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.when(F.col("doc_id").cast("bigint").isNull(), F.concat(F.lit("text "), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))))


def _taken(docs: DataFrame, weights: dict[str, float] | None, budget: float, costs: tuple[int, ...], alpha: float, seed: int) -> DataFrame:
    """``mix`` with the ``unit`` key of each document."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    names = F.transform(F.array_sort("sources"), lambda s: F.concat(F.lit("source:"), s))
    if any(c.startswith("lang:") for c in weights or ()):
        names = F.concat(names, F.transform(F.array_sort("langs"), lambda s: F.concat(F.lit("lang:"), s)))
    units = cut(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("print"), count_tokens(text).alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
        .filter("n_tokens > 0")
        .groupBy("print")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.collect_set("source").alias("sources"), F.collect_set("lang").alias("langs"))
        .withColumn("unit", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.lower(F.hex("print")))))
        .select("unit", "doc_id", "n_tokens", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("other:"))).alias("members"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "print")).otherwise(F.xxhash64(F.lit(seed), "doc_id")).alias("h"))
        .withColumn("pattern", F.array_join("members", "\x1f"))
    )
    bits = max(6, math.ceil(math.log2(max(1, units.count() / RANGE_DOCS))))
    units = units.withColumn("range", F.shiftright("h", 64 - bits))
    ranges = cut(units.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("tokens")))
    table = ranges.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).toArrow().sort_by("pattern")
    tokens = array("q", table["tokens"].to_numpy().tobytes())
    available: dict[str, int] = {}
    for own, n in zip(_members(table), tokens, strict=True):
        for c in own:
            available[c] = available.get(c, 0) + n
    components = sorted(available)
    quota = quotas({c: available[c] for c in components}, int(sum(tokens) * budget), weights, alpha)
    number = {c: i for i, c in enumerate(components)}
    flow = MixFlow(tokens, [tuple(number[c] for c in own) for own in _members(table)], [quota[c] for c in components], costs)
    plan = spark.createDataFrame(_plan(table, components, *flow.used()))
    before = ranges.select("pattern", "range", (F.sum("tokens").over(Window.partitionBy("pattern").orderBy("range")) - F.col("tokens")).alias("before"))
    inside = Window.partitionBy("pattern", "range").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        units.select("unit", "doc_id", "n_tokens", "pattern", "range", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"))
        .join(before, ["pattern", "range"])
        .join(plan, "pattern")
        .select("unit", "doc_id", "n_tokens", "capacity", "slices", (F.col("before") + F.col("start")).alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)).alias("epoch"))
    )
    middle = 2 * (F.col("epoch") * F.col("capacity") + F.col("start")) + F.col("n_tokens")
    found = laid.withColumn("middle", middle).withColumn("slice", F.get(F.expr("filter(slices, s -> 2 * s.low <= middle AND middle < 2 * s.high)"), F.lit(0)))
    return found.filter("slice is not null").select("unit", "doc_id", F.col("epoch").cast("int").alias("epoch"), F.col("slice.component").alias("component"), "n_tokens")


def _members(table: pa.Table) -> Iterator[list[str]]:
    for batch in table.select(["pattern"]).to_batches(10_000):
        for pattern in batch["pattern"].to_pylist():
            yield pattern.split("\x1f")


def _plan(table: pa.Table, components: list[str], pattern: np.ndarray, component: np.ndarray, amount: np.ndarray) -> pa.Table:
    """For each pattern in use its tokens, how many passes it takes, and the components' slices of its tokens, laid end to end."""
    starts = np.flatnonzero(np.r_[True, pattern[1:] != pattern[:-1]][: len(pattern)])
    sizes = np.diff(np.r_[starts, len(pattern)])
    high = np.cumsum(amount)
    high -= np.repeat(high[starts] - amount[starts], sizes)
    capacity = table["tokens"].to_numpy()[pattern[starts]]
    slices = pa.StructArray.from_arrays([pa.array(components, pa.string()).take(pa.array(component)), pa.array(high - amount), pa.array(high)], ["component", "low", "high"])
    return pa.table(
        {
            "pattern": table["pattern"].take(pa.array(pattern[starts])),
            "capacity": capacity,
            "epochs": -(-high[starts + sizes - 1] // capacity),
            "slices": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(pattern)], pa.int32()), slices),
        }
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, costs: tuple[int, ...] = COSTS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, epoch (from 0), component and n_tokens of the documents that are taken; a document taken several times has a row for each pass.

    Components are sources (``source:...``); languages (``lang:...``) are components only where ``weights`` names one, as each document has a
    language besides its source, and quotas of both would let it pass by its source's. A document is a text; those that several sources hold
    are members of all of these, under the least doc_id. Documents are added up by membership pattern (the sum of tokens of each pattern goes to
    the driver); the flow routes pattern tokens to component quotas at the least cost of repetition; then each pattern's documents, in
    the order of a seeded hash, are laid on its tokens, pass by pass, and belong to the component in whose share their middle lies.

    * Null or empty text, or no words: not taken. Null doc_id: a document like any, ordered by a hash of its text; the row's doc_id is null.
    * Without a source (nor, where languages count, a language): component ``other:``. Texts of any length are one document each.
    * Components without a weight take nothing. Quotas that all passes together can't fill are filled as far as they go.
    * Ties in the hash go by doc_id; repeated rows count once. An empty table gives an empty result. Further columns don't matter.
    """
    return _taken(docs, weights, budget, costs, alpha, seed).drop("unit")


def take_mixed(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, costs: tuple[int, ...] = COSTS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with all columns; a document taken several times is there as often.

    * Null or empty texts go, as they hold no tokens to mix. Of texts that are there twice, the row of the least doc_id is taken.
    * Repeated rows of a doc_id (or, without one, of a text) count once. An empty table gives an empty result.
    """
    unit = unused(docs, "unit__")
    taken = cut(_taken(docs, weights, budget, costs, alpha, seed).select(F.col("unit").alias(unit)))
    return one_row_per_id(docs.withColumn(unit, _unit_key(docs)), unit).join(taken, unit).select(*docs.columns)
