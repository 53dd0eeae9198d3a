"""Texts in chunks, and an exchange of what chunks hold that ships hashes, never texts.

A chunk is one row with the rows and texts of some documents, a few MB together. Chunks are
written once, as files bucketed by chunk, so later passes join answers to texts without
moving a text. A chunk's number is chosen so that all chunks of a writing task fall into one bucket: a file for each task.

In a pass, each chunk sends its distinct hashes with counts, sorted and split by
their leading bits into parts; a part of all chunks is one group, of a size that ``parts`` bounds
(hashes spread evenly, and a chunk sends a hash once however often it has it, so no key is hot).
An answer goes back for each chunk and part, in the order of the hashes sent; a chunk that computes its hashes
again therefore knows which answer belongs to which.

Chunks and parts both grow with the corpus, so above ``most_parts`` parts a message would hold few hashes. Then hashes
travel in two hops: some thousand chunks send to a relay of theirs for each range of hashes; a relay adds
up what its chunks sent and sends it on to the parts of its range, and deals the answers out again. Messages stay
some hundred hashes long, and no group holds more than a part's or a relay's share.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import shared_folder, ship, small_batches, written
from quillspark.llm.kernel import U64, column, lean, slices

SENT = "chunk bigint, kind int, part int, keys binary, second binary, counts array<binary>"
REPLY = "chunk bigint, kind int, part int, data binary, n bigint, v bigint"


def spark_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of bigints (Murmur3, 32 bits), by which it deals rows to buckets."""
    x = x.astype(np.int64).view(np.uint64)

    def turn(a: np.ndarray, by: int) -> np.ndarray:
        return (a << np.uint32(by)) | (a >> np.uint32(32 - by))

    h = np.full(len(x), seed, np.uint32)
    for word in (x.astype(np.uint32), (x >> U64(32)).astype(np.uint32)):
        h = turn(h ^ (turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _numbers(task: int, buckets: int) -> Iterator[int]:
    """Numbers of a task's chunks: all of one bucket, and of no other task."""
    at = task << 40
    while True:
        some = np.arange(at, at + max(1024, 4 * buckets))
        yield from some[spark_hash(some) % buckets == task % buckets].tolist()
        at += len(some)


def _fill(size: int, buckets: int) -> object:
    def row(chunk: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        cells = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("row", "t", "flag")]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *cells], ["chunk", "rows", "texts", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, room = _numbers(TaskContext.get().partitionId(), buckets), [], size
        for batch in batches:
            for lo, hi in slices(column(batch, "t"), size // 4):
                part = batch.slice(lo, hi - lo)
                held.append(part)
                room -= (pc.sum(pc.binary_length(column(part, "t"))).as_py() or 0) + 16 * part.num_rows
                if room <= 0:
                    yield row(next(numbers), held)
                    held, room = [], size
        if held:
            yield row(next(numbers), held)

    return run


class Corpus:
    """Chunks of a table: rows (array of struct), texts, flags (booleans of the caller)."""

    def __init__(self, docs: DataFrame, text: str, keep: Sequence[str], flag=None, size: int = 4 << 20, part_bytes: int = 16 << 20, most_parts: int = 2048):
        self.spark = ship(docs.sparkSession)
        small_batches(self.spark)  # else a bucket's chunks and answers are one batch
        docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("t"), (F.lit(False) if flag is None else flag).alias("flag"))
        self.row = docs.schema["row"].dataType.simpleString()
        total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.parts = 1 << max(6, math.ceil(math.log2(max(1, total / part_bytes))))
        # Parts that chunks send to: all of them, or ranges of them that relays serve.
        self.near = self.parts if self.parts <= most_parts else 1 << (self.parts.bit_length() // 2)
        self.relays = max(1, math.ceil(total / size / self.near))
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(total / (64 << 20)), 100_000))
        name = f"chunks_{uuid.uuid4().hex[:12]}"
        chunks = docs.mapInArrow(_fill(size, self.buckets), f"chunk bigint, rows array<{self.row}>, texts array<string>, flags array<boolean>")
        chunks.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(self.spark)}/{name}").bucketBy(self.buckets, "chunk").saveAsTable(name)
        self.table = self.spark.table(name)
        self.spark.sql(f"drop table {name}")  # the catalog's entry alone: the files are outside the warehouse, and self.table knows them

    def map(self, f: Callable, schema: str, *replies: DataFrame) -> DataFrame:
        """f(batches) over chunk, rows, texts, flags and replies (array of kind, part, data)."""
        if not replies:
            return self.table.mapInArrow(lean(f), schema)
        got = replies[0]
        for more in replies[1:]:
            got = got.unionByName(more)
        got = got.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "data")).alias("replies"))
        return self.table.join(got.hint("shuffle_hash"), "chunk", "left").mapInArrow(lean(f), schema)

    def exchange(self, sent: DataFrame, bits: int, answer: Callable[[Sequence[np.ndarray]], np.ndarray], sums: Callable | None = None) -> DataFrame:
        """Replies to what chunks sent with ``near`` parts. answer: a byte or more for each distinct key of a part, from its counts summed over chunks; sums: two integers of the part, from its number, keys and counts."""
        if self.near == self.parts:
            return written(sent.groupBy("kind", "part").applyInArrow(_answered(answer, sums), REPLY), "replies")
        sent = written(sent.withColumn("relay", F.pmod(F.xxhash64("chunk"), F.lit(self.relays))), "sent")
        by = [F.col("kind"), F.col("relay"), F.col("part")]
        onward = sent.groupBy(*by).applyInArrow(_merged(bits, self.near, self.parts), SENT)
        back = written(onward.groupBy("kind", "part").applyInArrow(_answered(answer, sums), REPLY), "replies")
        home = back.select("kind", F.expr(f"chunk div {self.near}").alias("relay"), F.expr(f"cast(chunk % {self.near} as int)").alias("part"), F.col("part").alias("fine"), "data", "n", "v")
        return written(sent.groupBy(*by).cogroup(home.groupBy("kind", "relay", "part")).applyInArrow(_dealt, REPLY), "replies")


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray, dict[int, dict[int, bytes]]]]:
    """chunk, rows, texts, flags, replies by kind and part."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            replies: dict[int, dict[int, bytes]] = {}
            if "replies" in batch.schema.names:
                for r in column(one, "replies")[0].as_py() or []:
                    replies.setdefault(r["kind"], {})[r["part"]] = r["data"]
            rows, texts, flags = (column(one, c).flatten() for c in ("rows", "texts", "flags"))
            yield column(one, "chunk")[0].as_py(), rows, texts, flags.to_numpy(zero_copy_only=False).astype(bool), replies


def shorten(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of hashes."""
    return h >> U64(64 - bits) if bits < 64 else h


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those that need more follow as eight bytes each. Most counts are 1, so the shuffle's compression makes little of them."""
    wide = counts >= 255
    return np.uint32(len(counts)).tobytes() + np.where(wide, 255, counts).astype(np.uint8).tobytes() + counts[wide].astype("<u8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=4 + n)
    return counts


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next, of as many bytes as make the message short; steps that need more follow as eight bytes each."""
    steps = np.diff(keys, prepend=U64(0))
    least = max(1, min(7, ((int(keys[-1]) // len(keys)).bit_length() + 7) // 8 if len(keys) else 1))  # for a step of mean size
    size = {w: len(steps) * w + 8 * int(np.count_nonzero(steps >= U64((1 << 8 * w) - 1))) for w in range(least, min(7, least + 1) + 1)}
    width = min(size, key=size.get)
    top = U64((1 << 8 * width) - 1)
    wide = steps >= top
    short = np.where(wide, top, steps).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.uint32(len(keys)).tobytes() + short.tobytes() + steps[wide].astype("<u8").tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], int(np.frombuffer(data, "<u4", 1, 1)[0])
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(n, width)
    steps = raw.view("<u8").ravel()
    steps[steps == U64((1 << 8 * width) - 1)] = np.frombuffer(data, "<u8", offset=5 + n * width)
    return np.cumsum(steps, dtype=U64)


def distinct(h: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct hashes, or pairs of hashes, sorted, and the place of each among them."""
    if second is None:
        keys, place = np.unique(h, return_inverse=True)
        return keys, None, place
    by = np.lexsort((second, h))
    h, second = h[by], second[by]
    new = np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1]))[: len(h)]
    place = np.empty(len(h), np.int64)
    place[by] = np.cumsum(new) - 1
    return h[new], second[new], place


def send(chunk: int, kind: int, keys: np.ndarray, bits: int, parts: int, counts: Sequence[np.ndarray], second: np.ndarray | None = None, within: int = 1, part: int = 0) -> pa.RecordBatch | None:
    """keys: distinct and sorted, of ``bits`` bits; counts: arrays beside them; second: hashes of the second family, where keys are pairs.

    within: the keys are of one of so many ranges, ``part``, and lack its leading bits.
    """
    if not len(keys):
        return None
    rest = bits - (parts.bit_length() - 1)
    fine = (keys >> U64(rest)).astype(np.int64)
    edge = np.searchsorted(fine, np.arange(parts // within + 1))
    own = np.flatnonzero(np.diff(edge))
    keys, n = keys & U64((1 << rest) - 1), len(own)
    cells = [pack_keys(keys[edge[p] : edge[p + 1]]) for p in own]
    beside = [[pack_counts(c[edge[p] : edge[p + 1]]) for c in counts] for p in own]
    more = pa.nulls(n, pa.binary()) if second is None else pa.array([second[edge[p] : edge[p + 1]].astype("<u8").tobytes() for p in own], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array((own + part * (parts // within)).astype(np.int32)), pa.array(cells, pa.binary()), more, pa.array(beside, pa.list_(pa.binary()))],
        ["chunk", "kind", "part", "keys", "second", "counts"],
    )


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys of a group's messages, with their second hashes and summed counts; the place of each hash sent among them, and where each message begins."""
    each = [unpack_keys(x.as_py()) for x in table["keys"]]
    edge = np.append(0, np.cumsum([len(x) for x in each]))
    second = None if table["second"].null_count else np.frombuffer(b"".join(x.as_py() for x in table["second"]), "<u8")
    keys, second, place = distinct(np.concatenate(each), second)
    cells = table["counts"].to_pylist()
    counts = [np.bincount(place, np.concatenate([unpack_counts(x[c]) for x in cells]), len(keys)).astype(np.int64) for c in range(len(cells[0]))]
    return keys, second, counts, place, edge


def _replies(table: pa.Table, values: np.ndarray, edge: np.ndarray, n: int, v: int) -> pa.Table:
    """n, v: sums of the group, on its first row."""
    first = [1] + [0] * (table.num_rows - 1)
    data = [pack_counts(values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"chunk": table["chunk"], "kind": table["kind"], "part": table["part"], "data": pa.array(data, pa.binary()), "n": pa.array([n * x for x in first], pa.int64()), "v": pa.array([v * x for x in first], pa.int64())})


def _answered(answer: Callable, sums: Callable | None) -> object:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, _, counts, place, edge = _received(table)
        n, v = sums(key[0].as_py(), key[1].as_py(), keys, counts) if sums else (0, 0)
        return _replies(table, answer(counts)[place], edge, n, v)

    return run


def _merged(bits: int, near: int, parts: int) -> object:
    """What a relay sends on for its chunks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, second, counts, _, _ = _received(table)
        relay, part = key[1].as_py(), key[2].as_py()
        return pa.Table.from_batches([send(relay * near + part, key[0].as_py(), keys, bits, parts, counts, second, near, part)])

    return run


def _dealt(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
    """The answers that a relay has got, for each of its chunks."""
    _, _, _, place, edge = _received(table)
    cells = [x.as_py() for x in replies.sort_by("fine")["data"]]
    return _replies(table, np.concatenate([unpack_counts(x) for x in cells])[place], edge, pc.sum(replies["n"]).as_py(), pc.sum(replies["v"]).as_py())


def answer(replies: dict[int, dict[int, bytes]], kind: int) -> np.ndarray:
    """One kind's answers in the order of the hashes sent."""
    own = replies.get(kind, {})
    return np.concatenate([np.zeros(0, np.int64), *(unpack_counts(own[p]) for p in sorted(own))])
