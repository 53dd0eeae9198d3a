"""Packing of token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A piece goes whole into the window that
it fills best. When none has room, the fullest window is topped up with the head of the
piece, if ``cut``, and emitted, and the rest of the piece is placed next. Pieces of a full
window's length are windows of their own. The pieces in windows left open at a partition's end
are merged in a second step, by groups of partitions, so no task gets more than a group's
leftovers: ``open_windows`` * ``group`` windows, whatever the size of the corpus.

Cases: a null or empty text is its end id alone. Ties go to the window opened first. Repeated
rows are packed as often as they occur. An empty table gives no rows. Long texts are cut into
windows; no id is dropped.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import ship, written
from quillspark.llm.kernel import column, lean

FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "full"]


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a file of ``tokenizers``, as (string, id). It matches them in texts whatever ``add_special_tokens`` is."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError(f"{path}: added tokens that match in other ways than as they are")
    return tuple((t["content"], t["id"]) for t in found)


@cache
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Callable[[str], list[int]]:
    """Ids by a byte-level BPE given as ranks; texts are split at added tokens, which have their own ids."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))

    def encode(text: str) -> list[int]:
        if any(t in text for t, _ in added):
            return bpe.encode(text, allowed_special="all", disallowed_special=())
        return bpe.encode_ordinary(text)

    return encode


class Packer:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int, name: Callable[[], int], cut: bool):
        self.size, self.most, self.name, self.cut = size, most, name, cut
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.closed: list[int] = []  # windows that were closed since the caller last looked

    def place(self, length: int) -> Iterator[tuple[int, int, int]]:
        """Parts of a piece as (length, window, offset)."""
        while length:
            if length >= self.size:
                self.closed.append(window := self.name())
                yield self.size, window, 0
                length -= self.size
                continue
            at = bisect_left(self.open, (length, -1))
            if at == len(self.open) and at >= self.most:
                room, window = self.open.pop(0)  # the fullest
                self.closed.append(window)
                if self.cut:
                    yield room, window, self.size - room
                    length -= room
                continue
            room, window = self.open.pop(at) if at < len(self.open) else (self.size, self.name())
            yield length, window, self.size - room
            if room > length:
                insort(self.open, (room - length, window))
            else:
                self.closed.append(window)
            length = 0


def _rows(pieces: list[tuple], kind: pa.DataType, full: bool) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([full] * len(pieces))], NAMES)


def _pack(path: str, pattern: str, added: tuple[tuple[str, int], ...], end: int, size: int, most: int, cut: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, names = encoder(path, pattern, added), TaskContext.get().partitionId() << 40, count()
        packer, waiting, kind = Packer(size, most, lambda: base + next(names), cut), defaultdict(list), None
        for batch in batches:
            out: list[tuple] = []
            rows = column(batch, "row")
            kind = rows.type
            for row, x in zip(rows.to_pylist(), column(batch, "t"), strict=True):
                ids = np.array([*encode(x.as_py() or ""), end], "<u4")
                start = 0
                for length, window, offset in packer.place(len(ids)):
                    waiting[window].append((row, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), window, offset))
                    start += length
                for window in packer.closed:
                    out += waiting.pop(window)
                packer.closed.clear()
                if len(out) >= 20_000:
                    yield _rows(out, kind, True)
                    out = []
            if out:
                yield _rows(out, kind, True)
        if waiting:
            yield _rows([x for pieces in waiting.values() for x in pieces], kind, False)

    return run


def _merge(size: int) -> object:
    """Best fit of the pieces that open windows held, the longest first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        base, names = 1 << 62 | key[0].as_py() << 32, count()
        packer = Packer(size, table.num_rows, lambda: base + next(names), False)
        placed = [part for length in table["length"].to_pylist() for part in packer.place(length)]
        for name, k in (("sequence_id", 1), ("offset", 2)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array([x[k] for x in placed], pa.int64()))
        return table.drop_columns(["full", "g"])

    return run


def pack(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", keep: Sequence[str] = ("doc_id",), end: int = 0, size: int = 1024, open_windows: int = 32, group: int = 64, cut: bool = True, added: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """One row for each piece: row (struct of the kept columns), start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of a file of byte-level BPE ranks, the same on every machine; pattern: its splitting pattern; added: its added tokens.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("t"))
    piece = f"row {docs.schema['row'].dataType.simpleString()}, {FIELDS}"
    packed = written(docs.mapInArrow(lean(_pack(vocabulary, pattern, tuple(added), end, size, open_windows, cut)), f"{piece}, full boolean"), "packing")
    left = packed.where("not full").withColumn("g", F.expr(f"shiftright(sequence_id, 40) div {group}"))
    return packed.where("full").drop("full").unionByName(left.groupBy("g").applyInArrow(_merge(size), piece))
