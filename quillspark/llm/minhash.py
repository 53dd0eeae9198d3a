"""Near-duplicate documents: an LSH forest of MinHash signatures, links confirmed on full shingle sets.

1. Each text's distinct word shingles give a signature of ``orders`` * ``depth`` MinHash values
   and a 128-bit key of the set. Documents with equal sets are one node from here on, so copies cost nothing more.
2. The forest: for each order, nodes are sorted by that order's part of the signature. Sorted
   neighbours, less than 2 * ``reach`` places apart, that share a long enough prefix are candidates:
   ``shallow`` values in a region (a run with one such prefix) of at most 2 * reach nodes, and in
   larger ones the depth at which a node's region has become as small. Nodes that many others equal
   in all of an order's values are linked with their next. ``shallow`` follows from the similarity: a
   linked pair misses it in all orders with a probability of at most 2e-5.
3. In regions of more than 2 * reach nodes, each node is a candidate with the region's pivots too: the
   nodes whose values the most others have, summed over their large regions and all depths of them. The original of many edited copies is such a node,
   also where the copies are too far from each other to be linked. So work stays linear in a region's size.
4. Candidates are confirmed by exact set similarity, first each node's best one and the pivots,
   then all whose ends are not yet in one component. Sets are shipped only for nodes with candidates: a
   bitmap of fixed size tells which, and what it lets through too much is dropped by a join.

5. What step 2 leaves out in large regions is finished exactly: each node of a large region that is not
   in its first pivot's component by then is compared, by its whole set, with all nodes of other components
   that share a region with it. Two nodes of a region are in one component or one of them is so compared,
   so no pair that shares a region is left out. Regions of one first pivot are one group, so a pair is
   compared once for a pivot, not for each order; a group is cut into blocks of ``block`` hashes, and a task
   gets two of them and gives only links that join components. Comparisons grow with the rows left over times the group.

Sets hold 64-bit hashes of shingles, so an intersection of two sets of a thousand is wrong with a probability of 1e-13; equal sets
are told by sums of two independent hashes, 128 bits together. A region that a partition boundary cuts is treated as a large one, whatever its size.

Cases: a null text, or one without words, has an empty set, links with nothing and is its own
component. Fewer words than a shingle: the whole sequence is the only shingle. Repeated rows
are copies. Null ids are larger than all others; a component of null ids alone has a null id and
keeps all its rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.cluster import drop, roots, ship, written
from quillspark.llm.components import components
from quillspark.llm.kernel import NOT_SPACE, U64, Words, column, lean, mix, slices, window_hashes


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: document (ascending), hash, size of each set, two keys of each set."""
    w = Words(texts, NOT_SPACE, lower=True)
    whole = w.whole(n)
    starts = [np.flatnonzero(whole)]
    found = [[w.windows(n, family)[0][whole]] for family in (0, 1)]
    for k in range(1, n):  # texts of fewer words
        own = w.bounds[np.flatnonzero(w.count == k)]
        if len(own):
            starts.append(own)
            for family in (0, 1):
                found[family].append(w.windows_at(own, k, family) + U64(k))
    doc = w.doc[np.concatenate(starts)]
    h, second = (np.concatenate(x) for x in found)
    by = np.argsort(mix(h ^ mix(doc.astype(U64) + U64(1))), kind="stable")
    by = by[np.append(True, (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1]))[: len(by)]]
    by = by[np.lexsort((h[by], doc[by]))]
    doc, h, second = doc[by], h[by], second[by]
    edge = np.searchsorted(doc, np.arange(w.n_docs + 1))
    keys = []
    for x in (h, second):  # sums of independent hashes, so a key is as good as 128 bits
        total = np.append(U64(0), np.cumsum(mix(x ^ U64(0x9FB21C651E98DF25))))
        keys.append(mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(U64)))
    return doc, h, np.diff(edge), np.stack(keys)


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return rng.integers(0, 1 << 63, n, np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The n MinHash values (32 bits) of each set; 0 for empty sets."""
    out = np.zeros((len(size), n), np.uint32)
    own = np.flatnonzero(size)
    if n and len(own):
        edge = (np.cumsum(size) - size)[own]
        for k, (a, b) in enumerate(zip(*_multipliers(n), strict=True)):
            out[own, k] = np.minimum.reduceat((h * a + b) >> U64(32), edge)
    return out


def _sign(n: int, values: int) -> object:
    """values: how many MinHash values; 0 for keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                doc, h, size, keys = shingle_sets(texts.slice(lo, hi - lo), n)
                raw = signatures(doc, h, size, values).astype(">u4").tobytes()  # big-endian: bytes sort as the values do
                binary = pa.Array.from_buffers(pa.binary(4 * values), len(size), [None, pa.py_buffer(raw)]).cast(pa.binary()) if values else pa.nulls(len(size), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "row").slice(lo, hi - lo), column(batch, "id").slice(lo, hi - lo), pa.array(size, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), binary], ["row", "id", "size", "k1", "k2", "s"]
                )

    return run


def _deal(signed: DataFrame, orders: int, depth: int, *more: str) -> DataFrame:
    """A row for each order of a node: o, p (its part of the signature), node and further columns."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda o: F.struct(o.alias("o"), F.substring("s", o * F.lit(4 * depth) + 1, F.lit(4 * depth)).alias("p")))
    return signed.select(F.explode(parts).alias("e"), "node", *more).select("e.o", "e.p", "node", *more)


def _runs(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: which begin a run of equal first ``width`` columns, and the size of each row's run."""
    new = np.append(True, (key[1:, :width] != key[:-1, :width]).any(1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    return first, np.repeat(size, size)


def _neighbours(depth: int, shallow: int, reach: int) -> object:
    """Over sorted rows. kind 0: candidate a < b, v: length of the common prefix. kind 1: node a lies in the large region b, v: rows with its first values, summed over all depths. A region that the partition's ends may cut counts as large."""

    def pairs(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        first, region_size = _runs(key, shallow + 1)  # the order itself is the first column
        # The depth at which a row's region is small; beyond all values where there is none.
        need, alike = np.full(len(key), depth + 1), np.zeros(len(key), np.int64)
        for d in range(depth, shallow - 1, -1):
            run_size = _runs(key, d + 1)[1]
            need[run_size <= 2 * reach] = d
            alike += run_size
        a, b, v = [], [], []
        for j in range(1, min(2 * reach, len(node))):
            same = np.cumprod(key[j:] == key[:-j], axis=1).sum(1) - 1
            near = same >= np.maximum(need[:-j], need[j:])
            if j == 1:
                near |= same == depth  # many nodes with all values of the order in common: a chain, besides the pivots
            at = np.flatnonzero(near)
            a.append(node[at])
            b.append(node[at + j])
            v.append(same[at])
        region = mix(window_hashes(mix(key[first].astype(U64)[:, : shallow + 1]), shallow + 1)[:, 0])
        large = region_size > 2 * reach
        large[: first[1] if len(first) > 1 else None] = large[first[-1] :] = True
        region = np.repeat(region, np.diff(np.append(first, len(node))))
        a, b, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, v))
        n = int(large.sum())
        cols = [np.append(np.zeros(len(a), np.int64), np.ones(n, np.int64)), np.append(np.minimum(a, b), node[large]), np.append(np.maximum(a, b), region[large].view(np.int64)), np.append(v, alike[large])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["kind", "a", "b", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []  # of a whole partition, so no region is cut between batches
        for batch in batches:
            if batch.num_rows:
                part = np.frombuffer(b"".join(column(batch, "p").to_pylist()), ">u4").reshape(-1, depth).astype(np.uint32)
                keys.append(np.concatenate([column(batch, "o").to_numpy().astype(np.uint32)[:, None], part], 1))
                nodes.append(column(batch, "node").to_numpy())
        if nodes:
            yield pairs(np.concatenate(keys), np.concatenate(nodes))

    return run


def _finish(percent: int) -> object:
    """Compares every row marked left with every other row by their whole sets; of the links, as many as join the components."""

    def sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = table["hs"].to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        return table["node"].to_numpy(), table["root"].to_numpy(), size, np.frombuffer(b"".join(raw), U64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, root, size, h = sets(table.filter(table["left"]))
        n2, r2, s2, h2 = sets(table.filter(pa.compute.invert(table["left"])).sort_by([("size", "ascending"), ("node", "ascending")]))
        a, b = [], []
        if len(node) and len(n2):
            words, ids = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(words, h2), len(words) - 1)
            known = words[at] == h2  # others are in no set of the left rows
            edge = np.append(0, np.cumsum(known))[np.append(0, np.cumsum(s2))]
            at, mark, first = at[known].astype(np.int32), np.zeros(len(words), np.uint8), np.append(0, np.cumsum(size))
            lows = np.searchsorted(s2, -(-size * percent // 100))
            highs = np.searchsorted(s2, 100 * size // percent, "right")
            joined: dict[int, int] = {}

            def find(x: int) -> int:
                while x in joined:
                    x = joined[x]
                return x

            for i in range(len(node)):
                lo, hi = lows[i], highs[i]
                if lo >= hi or (r2[lo:hi] == root[i]).all():
                    continue
                own = ids[first[i] : first[i + 1]]
                mark[own] = 1
                total = np.append(0, np.cumsum(mark[at[edge[lo] : edge[hi]]], dtype=np.int64))
                mark[own] = 0
                both = total[edge[lo + 1 : hi + 1] - edge[lo]] - total[edge[lo:hi] - edge[lo]]
                for k in lo + np.flatnonzero((both > 0) & (100 * both >= percent * (size[i] + s2[lo:hi] - both)) & (r2[lo:hi] != root[i])):
                    x, y = find(int(root[i])), find(int(r2[k]))
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        a.append(min(node[i], n2[k]))
                        b.append(max(node[i], n2[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _bits(size: int) -> object:
    """A slice of the bitmap, of ``size`` bits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        bits[table["slot"].to_numpy() % size] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


def _sets(n: int, bitmap) -> object:
    """The sets of the texts that the bitmap lets through, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)), set()
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                doc, h, size, keys = shingle_sets(texts.slice(lo, hi - lo), n)
                edge = np.append(0, np.cumsum(size))
                own = []
                for k in np.flatnonzero((bits[keys[0] % U64(len(bits))] == 1) & (size > 0)):
                    key = (int(keys[0, k]), int(keys[1, k]))
                    if key not in done:
                        done.add(key)
                        own.append(k)
                yield pa.RecordBatch.from_arrays([*(pa.array(k[own].view(np.int64)) for k in keys), pa.array([h[edge[k] : edge[k + 1]].tobytes() for k in own], pa.binary())], ["k1", "k2", "hs"])

    return run


def _confirm(percent: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(ok) for c in "ab"], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id", keep: Sequence[str] = ("doc_id",), shingle: int = 5, percent: int = 80, orders: int = 16, depth: int = 6, reach: int = 8, pivots: int = 2, block: int = 1 << 20, bitmap_bits: int = 1 << 27) -> DataFrame:
    """One row for each document row: row (struct of the kept columns), id, size (of its shingle set), component (smallest id reachable), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    row, kind = (docs.schema[c].dataType.simpleString() for c in ("row", "id"))
    shallow = min(depth, max(1, math.floor(math.log(1 - 2e-5 ** (1 / orders)) / math.log(percent / 100)))) if percent < 100 else depth
    fields = f"row {row}, id {kind}, size bigint, k1 bigint, k2 bigint, s binary"
    # Texts are not written with the signatures: where they are kept, the last step reads them and finds their keys again.
    again = text in keep
    first_pass = docs.withColumn("row", F.lit(None).cast(docs.schema["row"].dataType)) if again else docs
    signed = first_pass.mapInArrow(lean(_sign(shingle, orders * depth)), fields)
    signed = written(signed.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    nodes = written(signed.where("size > 0").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.first("size").alias("size")), "nodes")
    forest = written(signed.select(F.col("rid").alias("node"), "s").join(nodes.select("node"), "node", "left_semi"), "forest")
    n_nodes, shuffles = nodes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def in_order(dealt: DataFrame, n: int) -> DataFrame:
        return dealt.repartitionByRange(max(1, min(math.ceil(n * orders / 200_000), 100_000), shuffles), "o", "p", "node").sortWithinPartitions("o", "p", "node")

    sorted_ = in_order(_deal(forest, orders, depth), n_nodes)
    near = written(sorted_.mapInArrow(_neighbours(depth, shallow, reach), "kind bigint, a bigint, b bigint, v bigint"), "neighbours")
    drop(spark, roots(forest))
    pairs = near.where("kind = 0").groupBy("a", "b").agg(F.sum("v").alias("v"))
    members = near.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("region"), "v")
    weight = members.groupBy("node").agg(F.sum("v").alias("n"))
    best = members.join(weight, "node").groupBy("region", F.pmod("node", F.lit(64)).alias("salt")).agg(F.max(F.struct("n", (-F.col("node")).alias("node"))).alias("x"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("x")))).where(F.col("r") <= pivots).select("region", (-F.col("x.node")).alias("pivot"), "r")
    to_pivot = members.join(best, "region").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    pairs = written(pairs, "candidates")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    first = both.groupBy("a").agg(F.max_by("b", F.struct("v", (-F.col("b")).alias("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = written(first.unionByName(to_pivot).distinct(), "candidates")

    wanted = pairs.select("a", "b").unionByName(first).unionByName(members.select(F.col("node").alias("a"), F.col("node").alias("b"))).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.join(wanted, "node").select("node", "k1", "k2"), "wanted")
    bits = 1 << max(16, min(bitmap_bits.bit_length() - 1, (16 * max(1, wanted.count())).bit_length()))
    slots = wanted.select(F.col("k1").bitwiseAND(bits - 1).alias("slot")).distinct().withColumn("slice", F.expr(f"slot div {bits // 64}"))
    bitmap = np.zeros((64, bits // 64 // 8), np.uint8)
    for m in slots.groupBy("slice").applyInArrow(_bits(bits // 64), "slice bigint, m binary").collect():  # 64 slices of a fixed size
        bitmap[m["slice"]] = np.frombuffer(m["m"], np.uint8)
    bitmap = bitmap.tobytes()
    sets = docs.mapInArrow(lean(_sets(shingle, spark.sparkContext.broadcast(bitmap))), "k1 bigint, k2 bigint, hs binary")
    # One set for each node, found by the keys that the join has dealt by, so sets are not shuffled again.
    sets = written(sets.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "hs"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a")
        return x.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint")

    stars = written(components(confirmed(first)), "stars")
    root = {c: stars.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"}
    rest = pairs.join(first, ["a", "b"], "left_anti").join(root["a"], "a", "left").join(root["b"], "b", "left")
    rest = rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    links = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    stars = components(links.unionByName(confirmed(written(rest, "candidates"))))
    # Rows of large regions that are not in the component of the region's first pivot are compared with all of the region; regions of one first pivot are one group.
    rooted = written(members.select("node").distinct().join(stars, "node", "left").join(nodes, "node").select("node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    main = best.where("r = 1").select("region", F.col("pivot").alias("g")).join(rooted.select(F.col("node").alias("g"), F.col("root").alias("main")), "g")
    grouped = written(members.join(main, "region").select("g", "main", "node").distinct().join(rooted, "node"), "grouped")
    # A group in blocks of sets of bounded size: each block of left rows meets each block of the group.
    blocks = grouped.groupBy("g").agg(F.ceil(F.sum(F.when(F.col("root") != F.col("main"), F.col("size"))) / block).alias("n_left"), F.ceil(F.sum("size") / block).alias("n_all")).where("n_left > 0")
    salted = grouped.join(blocks, "g").withColumn("salt", F.xxhash64("node"))
    own = F.pmod("salt", "n_left"), F.pmod("salt", "n_all")
    every = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)) for c in ("n_left", "n_all")]
    cells = salted.where("root <> main").select("g", own[0].alias("i"), every[1].alias("j"), F.lit(True).alias("left"), "node", "root", "size")
    cells = cells.unionByName(salted.select("g", every[0].alias("i"), own[1].alias("j"), F.lit(False).alias("left"), "node", "root", "size"))
    more = cells.join(sets, "node").groupBy("g", "i", "j").applyInArrow(_finish(percent), "a bigint, b bigint")
    links = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    stars = components(links.unionByName(more.distinct()))
    rooted = nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component"))
    by_key = rooted.join(low, "root").select("k1", "k2", "component")
    rows = docs.mapInArrow(lean(_sign(shingle, 0)), fields) if again else signed
    out = rows.drop("s").join(by_key, ["k1", "k2"], "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("row", "id", "size", component.alias("component"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
