"""Repeated passages by prefix-partitioned suffix trees over words.

Only suffixes that can share ``MIN_WORDS`` words with another are put into trees: each window of that many words has a lightest
``SEED_WORDS``-word run (the least hash, the leftmost of equals), which every copy of the window has at the same place, so windows whose
lightest run occurs once in the corpus have no copy.

* Partition: the suffixes that begin from ``low`` to ``high`` words before a run all begin, if they repeat, with the same words from ``low`` before
  it to ``MIN_WORDS - high`` after its beginning. These words are the prefix; at first it is the run itself. A prefix at more than ``GROUP_ROWS``
  places is made longer by halving the stretch of beginnings, until its suffixes fit in memory or it is ``MIN_WORDS`` long: then it is a deep node
  itself, and its leaves needn't meet in one task.
* Tree: the suffixes of a group are sorted with the prefixes that neighbours share. Suffixes preceded by equal words are leaves of the same node
  one word earlier, so only left-diverse nodes count: the inner nodes of the trie of left contexts say where these begin. A node ``MIN_WORDS`` deep or more
  is a repeat of all its leaves, which nothing extends on either side within the words at hand.
* Repeats that are longer than the words at hand are found in overlapping pieces and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amalgam.llm.words import mix64, tidy, token_hashes
from amalgam.session import cut, filter_by_ids, one_row_per_id, unused

#: Words of the shortest passage, and of the run that partitions suffixes first.
MIN_WORDS, SEED_WORDS = 50, 18
#: Places that a prefix may have before it is made longer, and places whose trees are grown at once.
GROUP_ROWS, CHUNK_ROWS = 20_000, 10_000
#: Documents that are hashed at once.
_DOCS = 512

TOKEN = re.compile(r"[^ \t\n\r\f]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPAN = "doc_id bigint, kind string, word_start bigint, word_end bigint"
PLACE = "key binary, low int, high int, doc_id bigint, place int, left int, right int, context binary"


class Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


def run_hashes(h: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from prefix sums."""
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix64((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def lightest_runs(h: np.ndarray, powers: Powers, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that are lightest in a window of ``min_words`` words; nothing if there are fewer words."""
    if len(h) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = run_hashes(h, seed_words, powers)
    inside = min_words - seed_words + 1
    best = np.lib.stride_tricks.sliding_window_view(runs, inside).argmin(1) + np.arange(len(runs) - inside + 1)
    places = best[np.r_[True, best[1:] != best[:-1]]]
    return places, runs[places]


def _seeds(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in (whole.slice(at, _DOCS) for whole in batches for at in range(0, len(whole), _DOCS)):
        ids, places, runs = [], [], []
        for doc, h in zip(batch["doc_id"].to_pylist(), token_hashes(batch["text"]), strict=True):
            at, run = lightest_runs(h, powers, min_words, seed_words)
            ids.append(np.full(len(at), doc, np.int64)), places.append(at), runs.append(run)
        if ids:
            yield pa.record_batch({"doc_id": np.concatenate(ids), "place": np.concatenate(places).astype(np.int32), "seed": np.concatenate(runs).view(np.int64)})


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(context: pa.BinaryArray) -> np.ndarray:
    """The rows of a column of binaries of one length, without a copy."""
    ends = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1]
    return np.frombuffer(context.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(context), -1)


def _contexts(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """For each place of a shared run: the words around it that a window over it can have, as 64-bit hashes, and how many there are on both sides."""
    reach = min_words - seed_words
    for batch in (whole.slice(at, 64) for whole in batches for at in range(0, len(whole), 64)):
        rows = []
        for doc, h, found in zip(batch["doc_id"].to_pylist(), token_hashes(batch["text"]), batch["places"], strict=True):
            place, seed = (found.values.field(name).to_numpy() for name in ("place", "seed"))
            padded = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(min_words, np.uint64)])
            around = np.lib.stride_tricks.sliding_window_view(padded, reach + min_words)[place]
            rows.append((seed, np.full(len(place), doc, np.int64), place, np.minimum(place, reach), np.minimum(len(h) - place, min_words), around))
        if rows:
            seed, doc, place, left, right, around = (np.concatenate(x) for x in zip(*rows, strict=True))
            n = len(seed)
            yield pa.record_batch({"key": _binary(seed[:, None]), "low": np.zeros(n, np.int32), "high": np.full(n, reach, np.int32), "doc_id": doc, "place": place.astype(np.int32), "left": left.astype(np.int32), "right": right.astype(np.int32), "context": _binary(around)})


def _longer_prefixes(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """Each place under the two longer prefixes that halve its stretch of beginnings; where it has too few words for one, it isn't there."""
    reach = min_words - seed_words
    for batch in batches:
        low, high, left, right = (batch[c].to_numpy() for c in ("low", "high", "left", "right"))
        middle = (low + high) // 2
        context = _matrix(batch["context"])
        for a, b in ((low, middle), (middle + 1, high)):
            own = np.flatnonzero((a <= b) & (left >= a) & (right >= min_words - b))
            if len(own):
                keys = [b"%d-%d-" % (x, y) + xxhash.xxh3_128_digest(context[i, reach - x : reach + min_words - y].tobytes()) for i, x, y in zip(own.tolist(), a[own].tolist(), b[own].tolist(), strict=True)]
                out = batch.take(pa.array(own))
                for name, values in (("key", pa.array(keys, pa.binary())), ("low", pa.array(a[own], pa.int32())), ("high", pa.array(b[own], pa.int32()))):
                    at = out.schema.get_field_index(name)
                    out = out.set_column(at, name, values)
                yield out


def longest_earlier(shared: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For leaves in order, of which neighbours share ``shared`` words: the most that each shares with one of a lower ``rank``.

    That is the depth of the lowest node above it in which another leaf is first. Leaves go out from the highest rank on; those left stay linked.
    """
    n = len(rank)
    before, after, common = list(range(-1, n - 1)), list(range(1, n + 1)), [0, *shared.tolist(), 0]
    out = np.zeros(n, np.int64)
    for i in np.argsort(-rank, kind="stable").tolist():
        a, b = before[i], after[i]
        x, y = common[i], common[b]
        out[i] = max(x, y)
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
        common[b] = min(x, y)
    return out


def _agree(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the first words two matrices have in common in each row, ``most`` at most."""
    same = x == y
    return np.minimum(np.where(same.all(1), x.shape[1], same.argmin(1)), most)


def left_nodes(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last leaf of each inner node of the trie of sorted rows of which neighbours share ``shared`` words."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class SuffixTree:
    """The suffixes over one prefix, by the words that follow it (``ahead``) and those in front of it (``behind``, the nearest first)."""

    def __init__(self, behind: np.ndarray, ahead: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        order = sorted(range(len(ahead)), key=[row.tobytes() for row in ahead.astype(">u8")].__getitem__)
        self.order = np.array(order)
        self.right = _agree(ahead[order[1:]], ahead[order[:-1]], np.minimum(right[order[1:]], right[order[:-1]]))
        lefts = sorted(range(len(behind)), key=[row.tobytes() for row in behind.astype(">u8")].__getitem__)
        self.lefts = np.array(lefts)
        self.left = _agree(behind[lefts[1:]], behind[lefts[:-1]], np.minimum(left[lefts[1:]], left[lefts[:-1]]))
        self.place = np.empty(len(order), np.int64)
        self.place[self.order] = np.arange(len(order))

    def deep_leaves(self, depth: int, rank: np.ndarray) -> Iterator[tuple[str, np.ndarray, int, np.ndarray]]:
        """Kind, leaves, the words in front of the prefix at which they begin and the words from the prefix on, of nodes at least ``depth`` deep.

        ``repeat`` has the deepest node above a leaf, ``cut`` the deepest in which a leaf of a lower ``rank`` is first. Nodes that begin further in front come
        first; a leaf is there again only where a later one reaches further.
        """
        reached = {kind: np.zeros(len(self.order), np.int64) for kind in ("repeat", "cut")}
        for behind, first, last in left_nodes(self.left.tolist()):
            places = np.sort(self.place[self.lefts[first : last + 1]])
            shared = np.minimum.reduceat(self.right, places[:-1]) if len(places) < len(self.order) else self.right
            if len(places) < len(self.order) and places[-1] < len(self.right):
                shared[-1] = self.right[places[-2] : places[-1]].min()
            if behind + shared.max() < depth:
                continue
            leaves = self.order[places]
            for kind, most in (("repeat", np.maximum(np.r_[0, shared], np.r_[shared, 0])), ("cut", longest_earlier(shared, rank[leaves]))):
                deep = (behind + most >= depth) & (most > reached[kind][leaves])
                reached[kind][leaves[deep]] = most[deep]
                yield kind, leaves[deep], behind, most[deep]


class _Spans:
    def __init__(self) -> None:
        self.kinds: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {"repeat": [], "cut": []}

    def add(self, kind: str, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            self.kinds[kind].append((doc, start, end))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.kinds.items():
            if parts:
                doc, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.record_batch({"doc_id": doc, "kind": pa.array([kind] * len(doc), pa.string()), "word_start": start, "word_end": end})


def grow_trees(group: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, min_words: int, reach: int) -> Iterator[pa.RecordBatch]:
    """The spans of all groups of suffixes (rows with one number in ``group``)."""
    spans = _Spans()
    up, _ = Powers()(context.shape[1])
    whole = mix64((context * up[: context.shape[1]]).sum(1, dtype=np.uint64) + left.astype(np.uint64) * np.uint64(1000) + right.astype(np.uint64))
    order = np.lexsort((place, doc, whole, group))
    group, doc, place, left, right, context, whole = (x[order] for x in (group, doc, place, left, right, context, whole))
    # leaves with the same words throughout are one leaf, its first place
    same = (group[1:] == group[:-1]) & (whole[1:] == whole[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (context[1:] == context[:-1]).all(1)
    later, copied = np.r_[False, same], np.r_[False, same] | np.r_[same, False]
    copied, again = (x & (left + right >= min_words) for x in (copied, later))
    spans.add("repeat", doc[copied], place[copied] - left[copied], place[copied] + right[copied])
    spans.add("cut", doc[again], place[again] - left[again], place[again] + right[again])
    leaf = np.flatnonzero(~later)
    starts = np.flatnonzero(np.r_[True, group[leaf][1:] != group[leaf][:-1]])
    sizes = np.diff(np.r_[starts, len(leaf)])
    # trees of two leaves have one node each
    two = starts[sizes == 2]
    a, b = leaf[two], leaf[two + 1]
    behind = _agree(context[a, :reach][:, ::-1], context[b, :reach][:, ::-1], np.minimum(left[a], left[b]))
    ahead = _agree(context[a, reach:], context[b, reach:], np.minimum(right[a], right[b]))
    deep = behind + ahead >= min_words
    a, b, behind, ahead = a[deep], b[deep], behind[deep], ahead[deep]
    for x in (a, b):
        spans.add("repeat", doc[x], place[x] - behind, place[x] + ahead)
    x = np.where((doc[a] < doc[b]) | ((doc[a] == doc[b]) & (place[a] < place[b])), b, a)
    spans.add("cut", doc[x], place[x] - behind, place[x] + ahead)
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = leaf[at : at + n]
        rank = np.empty(n, np.int64)
        rank[np.lexsort((place[own], doc[own]))] = np.arange(n)
        tree = SuffixTree(context[own, :reach][:, ::-1], context[own, reach:], left[own], right[own])
        for kind, leaves, behind, ahead in tree.deep_leaves(min_words, rank):
            x = own[leaves]
            spans.add(kind, doc[x], place[x] - behind, place[x] + ahead)
    yield from spans.batches()


def _trees(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Trees of the groups of a partition that is sorted by key, as many groups at once as make ``chunk_rows`` places."""

    def grown(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        keys = table["key"].chunk(0)
        group = np.cumsum(np.r_[0, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
        doc, place, left, right = (table[c].to_numpy().astype(np.int64) for c in ("doc_id", "place", "left", "right"))
        yield from grow_trees(group, doc, place, left, right, _matrix(table["context"].chunk(0)), min_words, min_words - seed_words)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= chunk_rows:
            last = batch["key"][len(batch) - 1]
            table = pa.Table.from_batches(held)
            ended = pc.not_equal(table["key"], last)
            if done := int(pc.sum(ended).as_py() or 0):
                yield from grown(table.slice(0, done))
            rest = table.slice(done).combine_chunks()
            held, rows = rest.to_batches(), len(rest)
    if rows:
        yield from grown(pa.Table.from_batches(held))


def _equal_places(rows: DataFrame) -> DataFrame:
    """Rows with their node's first place as ``first``, of (key, doc_id, place, ..); keys that occur once are left out.

    The node's leaves are its rows, however many; AQE splits a crowded key in the join.
    """
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "key").withColumn("later", F.struct("doc_id", "place") != F.col("first"))


def _node_spans(placed: DataFrame, before: str, after: str) -> DataFrame:
    span = placed.select("doc_id", "later", (F.col("place") - F.expr(before)).cast("bigint").alias("word_start"), (F.col("place") + F.expr(after)).cast("bigint").alias("word_end"))
    return span.select("doc_id", F.lit("repeat").alias("kind"), "word_start", "word_end").union(span.filter("later").select("doc_id", F.lit("cut"), "word_start", "word_end"))


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a document and kind, joined where they touch or overlap."""
    own = Window.partitionBy("doc_id", "kind").orderBy("word_start", "word_end")
    before = F.max("word_end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", F.coalesce((F.col("word_start") > before).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("new").over(own))
        .groupBy("doc_id", "kind", "island")
        .agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))
        .select("doc_id", "kind", "word_start", "word_end", (F.col("word_end") - F.col("word_start")).alias("n_words"))
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, kind, word_start, word_end (exclusive) and n_words of passages of at least ``min_words`` words that occur more than once.

    Words are runs of characters other than ASCII whitespace, compared by 64-bit hashes of their bytes. Kind ``repeat``: the words covered by
    repeats of at least ``min_words`` words, which also occur elsewhere, in this document or another. Kind ``cut``: those covered by repeats with an
    occurrence that is earlier (a smaller doc_id, or further ahead in the document); without them each passage is there once.

    * Null doc_id or text: left out. Fewer than ``min_words`` words: no rows. An empty table: an empty result.
    * Repeated rows of a doc_id count once (the one with the least text). Whole texts at any length. Of equal passages the earliest is the first.
    * Only doc_id and text are used, so further columns don't matter.
    """
    reach = min_words - seed_words
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna(), "doc_id")
    seeds = cut(docs.mapInArrow(lambda it: tidy(_seeds(it, min_words, seed_words)), "doc_id bigint, place int, seed bigint"))
    counts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place, crowd = F.struct("place", "seed"), F.col("n") > group_rows
    by_doc = cut(seeds.join(counts, "seed").groupBy("doc_id").agg(F.collect_list(F.when(~crowd, place)).alias("some"), F.collect_list(F.when(crowd, place)).alias("crowded")))

    def around(kind: str) -> DataFrame:
        chosen = by_doc.filter(F.size(kind) > 0).select("doc_id", F.col(kind).alias("places"))
        wanted = filter_by_ids(docs, cut(chosen.select("doc_id")), "doc_id", keep=True)
        return wanted.join(chosen, "doc_id").select("doc_id", "text", "places").mapInArrow(lambda it: tidy(_contexts(it, min_words, seed_words)), PLACE)

    parts, trees = [], [around("some")]
    if not by_doc.filter(F.size("crowded") > 0).isEmpty():
        rows = cut(around("crowded"))
        # places with the same words throughout are one leaf, the first; the spans of its copies are all of these words
        same = cut(_equal_places(rows.withColumn("key", F.concat("key", F.unhex(F.md5(F.concat("context", F.encode(F.concat_ws(",", "left", "right"), "UTF-8"))))))))
        parts.append(_node_spans(same.filter(F.col("left") + F.col("right") >= min_words), "left", "right"))
        rows = cut(rows.join(same.filter("later").select("doc_id", "place"), ["doc_id", "place"], "left_anti").select(*rows.columns))
        while True:
            crowded = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select("key"))
            trees.append(filter_by_ids(rows, crowded, "key", keep=False))
            if crowded.isEmpty():
                break
            longer = cut(filter_by_ids(rows, crowded, "key", keep=True).mapInArrow(lambda it: tidy(_longer_prefixes(it, min_words, seed_words)), PLACE))
            parts.append(_node_spans(_equal_places(longer.filter("low = high").select("key", "low", "doc_id", "place")), "low", f"({min_words} - low)"))
            rows = longer.filter("low < high")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for rows in trees:
        grown = rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda it: tidy(_trees(it, min_words, seed_words, chunk_rows)), SPAN)
        parts.append(grown)
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return _joined(spans)


def without_words(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans and the whitespace after each of them."""
    words = list(TOKEN.finditer(text))
    out, at = [], 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        out.append(text[at : words[a].start()])
        at = words[b].start() if b < len(words) else len(text)
    return "".join([*out, text[at:]])


def cut_repeats(docs: DataFrame, **parameters: int) -> DataFrame:
    """``docs`` with the ``cut`` passages taken out of text (and n_chars set to the new length, if there is such a column).

    Documents of which nothing but whitespace is left go; all others stay, with all columns. Rows with a null doc_id or text stay as they are; of repeated
    rows of a doc_id one stays.
    """
    docs = one_row_per_id(docs, "doc_id")
    cuts = cut(
        repeated_passages(docs, **parameters)
        .filter("kind = 'cut'")
        .groupBy("doc_id")
        .agg(F.collect_list("word_start").alias("starts"), F.collect_list("word_end").alias("ends"))
    )
    ids = cut(cuts.select("doc_id"))
    starts, ends = unused(docs, "starts__"), unused(docs, "ends__")
    whole = filter_by_ids(docs, ids, "doc_id", keep=False)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch[starts].to_pylist(), batch[ends].to_pylist(), strict=True)
            texts = [without_words(t, a, b) for t, a, b in rows]
            out = batch.drop_columns([starts, ends])
            for name, values in (("text", texts), ("n_chars", [len(t) for t in texts])):
                if name in out.schema.names:
                    at = out.schema.get_field_index(name)
                    out = out.set_column(at, out.schema.field(at), pa.array(values, out.schema.field(at).type))
            yield out.filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    renamed = cuts.select("doc_id", F.col("starts").alias(starts), F.col("ends").alias(ends))
    joined = filter_by_ids(docs, ids, "doc_id", keep=True).join(renamed, "doc_id").select(*docs.columns, starts, ends)
    return whole.unionByName(joined.mapInArrow(lambda it: tidy(shorten(it)), docs.schema))
