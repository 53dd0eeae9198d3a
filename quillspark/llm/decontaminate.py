"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, a-z and non-ASCII characters. The smallest hash of
the ``gram``-word runs inside each ``window``-word window is a fingerprint, so whenever a
document and an item share a window, they share its fingerprint. Fingerprints are joined,
and each hit is extended over the windows around it; a window counts if its whole word
sequence is one of an item's, by two independent 64-bit hashes. An item of fewer words than a window is a window of its own length.

Two ways to join, with the same rows:

* the items' index is broadcast if it takes at most ``broadcast_bytes``: the items' text is measured before it is brought
  to the driver (an eighth of that at most), the index itself before it is sent;
* otherwise fingerprints and windows are shuffled and joined by hash, and only documents
  that hold some item's fingerprint are read a second time.

Cases: a null or empty text has no words (0, 0, no items). Items that are null, empty or
without an id take no part; items with the same id are one item. Repeated document rows each
get their row. No items: nothing is hit. Other columns of either table are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.cluster import ship, written
from quillspark.llm.kernel import ALNUM, Words, column, cover, lean, member, minima, slices

SPAN = "array<struct<start:bigint,length:bigint>>"


class Index:
    """Windows of the items: fingerprints, window hashes by length, and the items of each window."""

    def __init__(self, ids: Sequence[str], texts: pa.Array, window: int, gram: int):
        words = Words(texts, ALNUM, lower=True)
        self.window, self.gram = window, gram
        self.ids = np.array(sorted(set(ids)), object)
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[x] for x in ids], np.int64)
        self.fingerprints = np.unique(fingerprints(words, window, gram)[1])
        # By length: hashes of both families, sorted by the first, and the items of each.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({window, *(int(k) for k in np.unique(words.count) if 0 < k < window)}):
            h, whole = words.windows(n)
            doc = words.doc[: len(h)]
            if n < window:
                whole = whole & (words.count[doc] == n)
            pairs = np.unique(np.stack([h[whole], words.windows(n, 1)[0][whole], item[doc[whole]].astype(np.uint64)], 1), axis=0)
            if len(pairs):
                first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)))
                self.windows[n] = (pairs[first, 0], pairs[first, 1], np.append(first, len(pairs)), pairs[:, 2].astype(np.int64))

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.fingerprints, *(a for w in self.windows.values() for a in w))) + sum(len(x) + 64 for x in self.ids)

    def find(self, words: Words, starts: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the windows that are an item's, and which."""
        keys, second, _, _ = self.windows[n]
        found, at = member(h, keys)
        starts, at = starts[found], at[found]
        sure, open_ = words.windows_at(starts, n, 1), np.ones(len(starts), bool)
        out = np.full(len(starts), -1)
        while open_.any():  # again only where items' windows have equal first hashes
            hit = open_ & (second[at] == sure)
            out[hit] = at[hit]
            more = open_ & ~hit & (at + 1 < len(keys))
            open_ = more & (keys[np.minimum(at + 1, len(keys) - 1)] == keys[at])
            at = at + open_
        return starts[out >= 0], out[out >= 0]


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the window minima."""
    h, whole = words.windows(gram)
    m = max(0, len(words) - window + 1)
    picked = minima(h, window - gram + 1, words.whole(window)[:m])
    at = np.flatnonzero(picked & whole)
    return at, h[at]


def around(words: Words, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a fingerprint at one of these places."""
    m = max(0, len(words) - window + 1)
    near = np.zeros(m, bool)
    for k in range(window - gram + 1):
        s = at - k
        near[s[(s >= 0) & (s < m)]] = True
    return np.flatnonzero(near & words.whole(window))


def hits(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and the pairs (text, item) of occurring windows."""
    hit, pairs = np.zeros(len(words), bool), [np.zeros((0, 2), np.int64)]
    for n, (_, _, first, items) in index.windows.items():
        h, whole = words.windows(n)
        if n == index.window:
            at, prints = fingerprints(words, n, index.gram)
            starts = around(words, at[member(prints, index.fingerprints)[0]], n, index.gram)
        else:
            starts = np.flatnonzero(whole)
        starts, key = index.find(words, starts, h[starts], n)
        if len(starts):
            hit |= cover(starts, n, len(words))
            size = first[key + 1] - first[key]
            each = np.repeat(first[key], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.unique(np.stack([np.repeat(words.doc[starts], size), items[each]], 1), axis=0))
    return hit, np.unique(np.concatenate(pairs), axis=0)


def runs(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start within it and length of each run of hit words."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(at) != 1) | (np.diff(words.doc[at]) != 0))
    first = np.flatnonzero(new)
    doc = words.doc[at[first]]
    return doc, at[first] - words.bounds[doc], np.diff(np.append(first, len(at)))


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _scan(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), ALNUM, lower=True)
                n = words.n_docs
                hit, pairs = hits(words, ix)
                doc, start, length = runs(words, hit)
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "row").slice(lo, hi - lo),
                        pa.array(words.count, pa.int64()),
                        pa.array(np.bincount(words.doc[hit], minlength=n), pa.int64()),
                        _lists(doc, n, spans),
                        _lists(pairs[:, 0], n, pa.array(ix.ids[pairs[:, 1]].tolist(), pa.string())),
                    ],
                    ["row", "words", "hit_words", "spans", "items"],
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """One row for each document row: row (struct of the kept columns), words, hit_words, spans (runs of hit words), items (ids with occurring windows, sorted as strings)."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("t"))
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("t")).where("item is not null and length(t) > 0")
    row = docs.schema["row"].dataType.simpleString()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("item")), F.lit(0))).first()[0]
    index = None
    if 8 * size <= broadcast_bytes:
        table = items.toArrow()
        index = Index(table["item"].to_pylist(), table["t"].combine_chunks(), window, gram)
    if index is None or index.nbytes() > broadcast_bytes:
        return _joined(docs, items, row, window, gram)
    return docs.mapInArrow(lean(_scan(spark.sparkContext.broadcast(index))), f"row {row}, words bigint, hit_words bigint, spans {SPAN}, items array<string>")


# The way for items too large to broadcast.


def _emit(window: int, gram: int, short: Sequence[int], what: str) -> object:
    """what: "prints": hashes by which a row may share a window. "windows": windows around the prints in column m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), ALNUM, lower=True)
                out = []
                own = column(batch, "m").slice(lo, hi - lo) if what == "windows" else None
                for n in [window, *short]:
                    h, whole = words.windows(n)
                    if n == window:
                        at, prints = fingerprints(words, window, gram)
                        if own is not None:
                            wanted = np.unique(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                            at = around(words, at[member(prints, np.sort(wanted))[0]], window, gram)
                            prints = h[at]
                    else:
                        at = np.flatnonzero(whole)
                        prints = h[at]
                    second = words.windows_at(at, n, 1) if what == "windows" else prints
                    out.append((words.doc[at], at - words.bounds[words.doc[at]], prints, second, np.full(len(at), n)))
                doc, pos, h, second, n = (np.concatenate(x) for x in zip(*out, strict=True))
                ids = column(batch, "id").slice(lo, hi - lo).to_numpy()
                if what == "prints":
                    pairs = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0].astype(np.int64)]), pa.array(pairs[:, 1].view(np.int64))], ["id", "h"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(pos.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n.astype(np.int64))], ["id", "start", "h", "second", "length"])

    return run


def _item_rows(window: int, gram: int, what: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = column(batch, "item").to_pylist()
            index = Index(names, column(batch, "t"), window, gram)
            if what == "prints":
                h = np.concatenate([index.fingerprints, *(w[0] for n, w in index.windows.items() if n < window)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
            for n, (keys, second, first, items) in index.windows.items():
                if what == "windows":
                    h = [pa.array(np.repeat(x, np.diff(first)).view(np.int64)) for x in (keys, second)]
                    yield pa.RecordBatch.from_arrays([*h, pa.array(np.full(len(items), n)), pa.array(index.ids[items].tolist(), pa.string())], ["h", "second", "length", "item"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "t")
        counts = [Words(texts.slice(lo, hi - lo), ALNUM, lower=True).count for lo, hi in slices(texts)]
        yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "row"), pa.array(np.concatenate(counts or [np.zeros(0)]), pa.int64())], ["id", "row", "words"])


def _joined(docs: DataFrame, items: DataFrame, row: str, window: int, gram: int) -> DataFrame:
    docs = written(docs.withColumn("id", F.monotonically_increasing_id()), "decontaminate")
    key = ["h", "second", "length"]
    windows = written(items.mapInArrow(_item_rows(window, gram, "windows"), "h bigint, second bigint, length bigint, item string").distinct(), "windows")
    short = sorted(r[0] for r in windows.where(F.col("length") < window).select("length").distinct().collect())  # window - 1 rows at most
    prints = items.mapInArrow(_item_rows(window, gram, "prints"), "h bigint").distinct()
    shared = docs.mapInArrow(_emit(window, gram, short, "prints"), "id bigint, h bigint").join(prints, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("m"))
    near = docs.join(shared, "id").mapInArrow(_emit(window, gram, short, "windows"), "id bigint, start bigint, h bigint, second bigint, length bigint")
    near = written(near.join(windows.select(*key).distinct(), key, "left_semi"), "near")
    # Windows that touch are one span.
    by_start = Window.partitionBy("id").orderBy("start")
    ends = near.groupBy("id", "start").agg(F.max(F.col("start") + F.col("length")).alias("end")).withColumn("before", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    islands = ends.withColumn("island", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(by_start))
    spans = islands.groupBy("id", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    spans = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # Pairs of a document and an item are what is returned; windows that many items share are joined one by one, never gathered.
    met = near.select("id", *key).distinct().join(windows, key).select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return (
        docs.mapInArrow(_counts, f"id bigint, row {row}, words bigint")
        .join(spans, "id", "left")
        .join(met, "id", "left")
        .select("row", "words", F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.length)"), F.lit(0)).alias("hit_words"), F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    )
