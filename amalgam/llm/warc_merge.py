"""Capture index by external merge: locally sorted runs, merged by a loser tree on URL key and timestamp."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.session import cut

#: Captures that a run has at most (longer inputs of a task give several runs), and captures of a key range on average.
RUN_ROWS, RANGE_ROWS = 200_000, 200_000
#: The first capture's time and the seconds between captures, for pages that carry no time of their own.
CRAWL_START, CRAWL_STEP = "2024-01-01 00:00:00", 37

SCHEMA = "url_key string, captured_at timestamp, page_id bigint, digest string"
MERGED = "url_key string, captured_at timestamp, page_id bigint, digest string, capture_no bigint, n_captures bigint, previous_at timestamp, changed boolean, part bigint, place bigint"
RESULT = ["global_rank", "url_key", "captured_at", "page_id", "capture_no", "n_captures", "previous_at", "changed"]


def url_key(url: Column) -> Column:
    """A sort-friendly key: the host's labels reversed, without scheme, user, default port, leading www, fragment and tracking parameters; parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_extract(bare, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":(80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: ~p.startswith("utm_") & (p != ""))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise("")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), query)


class LoserTree:
    """A tournament over the heads of k sorted runs. An inner node holds the run that lost there; the winner is kept apart."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.loser = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        """Run a's head goes before run b's; an ended run goes last, equal heads go by the run's number."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won = self._beats(a, b)
        self.loser[node] = b if won else a
        return a if won else b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place of each row, in order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            best, node = run, (run + self.k) // 2
            while node:
                if self._beats(self.loser[node], best):
                    self.loser[node], best = best, self.loser[node]
                node //= 2
            self.winner = best


def _keys(table: pa.Table) -> list[tuple]:
    """What rows are ordered by: URL key (in UTF-8), time, page_id and digest, nulls first."""
    at = table["captured_at"].cast(pa.int64()).to_pylist()
    return [
        (k.encode(), -(2**63) if t is None else t, -(2**63) if p is None else p, d or "")
        for k, t, p, d in zip(table["url_key"].to_pylist(), at, table["page_id"].to_pylist(), table["digest"].to_pylist(), strict=True)
    ]


def _form_runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in sorted runs, each with the task's number, the run's and the place in it."""
    task, run, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def sealed() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        keys = _keys(table)
        table = table.take(sorted(range(len(keys)), key=keys.__getitem__))
        for name, value in (("task", np.full(len(keys), task)), ("run", np.full(len(keys), run)), ("seq", np.arange(len(keys)))):
            table = table.append_column(name, pa.array(value, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= run_rows:
            yield from sealed()
            run, held, rows = run + 1, [], 0
    if rows:
        yield from sealed()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs' shares of one key range, which come one after the other; histories are counted within the range."""
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    task, run = (table[c].to_numpy() for c in ("task", "run"))
    cuts = [0, *(np.flatnonzero((np.diff(task) != 0) | (np.diff(run) != 0)) + 1).tolist(), len(task)]
    keys = _keys(table)
    order = np.fromiter((cuts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])), np.int64, len(task))
    out = table.select(["url_key", "captured_at", "page_id", "digest"]).take(order)
    key, digest = out["url_key"].to_numpy(), np.asarray(out["digest"].to_pylist(), object)
    first = np.ones(len(out), bool)
    first[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(first)
    length = np.diff([*start, len(out)])
    changed = first.copy()
    changed[1:] |= digest[1:] != digest[:-1]
    before = pa.array(np.maximum(np.arange(len(out)) - 1, 0), mask=first)
    for name, value in (
        ("capture_no", pa.array(np.arange(len(out)) - np.repeat(start, length) + 1, pa.int64())),
        ("n_captures", pa.array(np.repeat(length, length), pa.int64())),
        ("previous_at", out["captured_at"].combine_chunks().take(before)),
        ("changed", pa.array(changed)),
        ("part", pa.array(np.full(len(out), TaskContext.get().partitionId()), pa.int64())),
        ("place", pa.array(np.arange(len(out)), pa.int64())),
    ):
        out = out.append_column(name, value)
    yield from out.to_batches(max_chunksize=10_000)


def _stitches(merged: DataFrame) -> list[tuple]:
    """For each range, in order: its number, the captures before it, how many of its first URL's captures are before it and when the last of these was
    and its digest, whether there is one, and the captures of its first and of its last URL in all ranges.

    One row a range comes to the driver.
    """
    ends = (
        merged.groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min_by(F.struct("url_key", "n_captures"), "place").alias("first"),
            F.max_by(F.struct("url_key", "n_captures", F.unix_micros("captured_at").alias("at"), "digest"), "place").alias("last"),
        )
        .orderBy("part")
        .collect()
    )
    totals: dict[str, int] = {}
    for r in ends:
        for side in {r["first"]["url_key"]: r["first"]["n_captures"], r["last"]["url_key"]: r["last"]["n_captures"]}.items():
            totals[side[0]] = totals.get(side[0], 0) + side[1]
    out, before, seen, last = [], 0, 0, None
    for r in ends:
        same = last is not None and last["url_key"] == r["first"]["url_key"]
        seen = seen if same else 0
        out.append((r["part"], before, r["first"]["url_key"], seen, same, last["at"] if same else None, last["digest"] if same else None, totals[r["first"]["url_key"]], r["last"]["url_key"], totals[r["last"]["url_key"]]))
        before += r["rows"]
        seen = r["last"]["n_captures"] + (seen if r["first"]["url_key"] == r["last"]["url_key"] else 0)
        last = r["last"]
    return out


def merge_captures(captures: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered capture histories of (url_key, captured_at, page_id, digest).

    Each task sorts its rows into runs, which are written. They are cut at common boundaries into ranges of about ``range_rows`` captures, by URL key,
    time and all else that orders captures, so that a URL with many captures is cut too; each range is merged by a loser tree, and ranges follow each other
    in global order. Histories that go on from one range to the next are put together from the ends of the ranges. Columns: global_rank (from 1), url_key,
    captured_at, page_id, capture_no and n_captures in the URL's history, previous_at, and changed: whether the digest differs from the previous
    capture's (true for the first).

    * A null url_key has no history: such rows are left out. An empty one is a URL like any. Null times come first in their history, then null page_ids.
    * Ties in key and time go by page_id, then digest (null as an empty one); repeated rows all stay, one after the other. A null digest equals only a null one.
    * URLs of any length are compared whole. An empty table gives an empty result. Only the four columns are used, so further columns don't matter.
    """
    wanted = captures.select("url_key", "captured_at", F.col("page_id").cast("bigint").alias("page_id"), "digest").filter("url_key is not null")
    extra = ", task bigint, run bigint, seq bigint"
    runs = cut(wanted.mapInArrow(lambda it: _form_runs(it, run_rows), SCHEMA + extra))
    ranges = max(1, -(-runs.count() // range_rows))
    order = ["url_key", "captured_at", "page_id", F.coalesce("digest", F.lit("")), "task", "run", "seq"]
    merged = cut(runs.repartitionByRange(ranges, *order).sortWithinPartitions("task", "run", "seq").mapInArrow(_merge_runs, MERGED))
    named = "part bigint, before bigint, first_key string, seen bigint, goes_on boolean, last_at bigint, last_digest string, first_total bigint, last_key string, last_total bigint"
    # one row for each range
    ends = merged.sparkSession.createDataFrame(_stitches(merged), named)
    leads = F.col("goes_on") & (F.col("place") == 0)
    return (
        merged.join(F.broadcast(ends), "part")
        .withColumn("global_rank", F.col("before") + F.col("place") + 1)
        .withColumn("changed", F.when(leads, ~F.col("digest").eqNullSafe(F.col("last_digest"))).otherwise(F.col("changed")))
        .withColumn("previous_at", F.when(leads, F.timestamp_micros("last_at")).otherwise(F.col("previous_at")))
        .withColumn("capture_no", (F.col("capture_no") + F.when(F.col("url_key") == F.col("first_key"), F.col("seen")).otherwise(0)).cast("int"))
        .withColumn("n_captures", F.when(F.col("url_key") == F.col("first_key"), F.col("first_total")).when(F.col("url_key") == F.col("last_key"), F.col("last_total")).otherwise(F.col("n_captures")))
        .select(*RESULT)
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of raw pages: url_key, captured_at (the crawl's start plus a step for each page_id; null without page_id), page_id, digest of html."""
    return pages.select(
        url_key(F.col("url")).alias("url_key"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(CRAWL_START)) + F.col("page_id") * CRAWL_STEP).alias("captured_at"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.md5("html").alias("digest"),
    )
