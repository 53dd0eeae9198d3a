"""Quality scores of texts: random Fourier features on document statistics, ridge regression, isotonic calibration.

Statistics of whole texts (lengths, shares of byte and word classes, repetition) are
standardised and mapped to ``features`` cosines that approximate a Gaussian kernel. Each
partition sums its own part of the normal equations, by fold; the sums are added and solved
on the driver, whose work depends on ``features`` alone. Raw scores of each fold by the
equations of the other folds are calibrated by isotonic regression over fixed bins.

The fit uses at most about ``max_labelled`` labelled rows: above that, rows are drawn by a
hash of the text, at the rate that gives so many. Every text is scored.

Cases: a null or empty text has statistics of its own (all 0) and gets a score. A row whose
id is null has no label and is not held out. Several labels of one id are averaged. Repeated
rows are learned and scored as often as they occur. Without any label each score is 0.5; with labels of one
kind it is that label. Labels that are null are no labels. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import ship, written
from quillspark.llm.kernel import U64, Words, column, lean, mix, slices

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!?", b"#$%&*@^~+=<>_\\", b"|", b"()[]{}", b"\"'`", b"-/", b"\n", bytes(range(128, 256))]
BINS, LOW, HIGH = 2000, -0.5, 1.5


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    w = Words(texts)
    n, size = w.n_docs, np.diff(w.offsets)
    chars, count = np.maximum(size, 1), np.maximum(w.count, 1)

    def by_word(x: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(x, dtype=np.float64))
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    def by_byte(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[w.raw], dtype=np.int32))
        return (total[w.offsets[1:]] - total[w.offsets[:-1]]) / chars

    def repetition(h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        key, first, times = np.unique(mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        of = doc[first]
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        most = np.zeros(n)
        np.maximum.at(most, of, times)
        distinct = np.bincount(of, minlength=n)
        return [distinct / total, np.log1p(distinct) / np.log1p(total + 1), most / total, np.bincount(of, (times == 1), minlength=n) / total, np.bincount(of, times * np.log(times), minlength=n) / total / np.log1p(total)]

    length = (w.end - w.start).astype(np.float64)
    first, last = (w.raw[w.start], w.raw[w.end - 1]) if len(w) else (np.zeros(0, np.uint8),) * 2
    upper, lower, stop = _members(_CLASSES[0]), _members(_CLASSES[1]), _members(b".!?")
    plain = upper | lower | _members(_CLASSES[2]) | _members(_CLASSES[-1])
    mean = by_word(length) / count
    small = np.append(0, np.cumsum(lower[w.raw], dtype=np.int32))
    no_lower = (small[w.end] == small[w.start]) & upper[first]
    again = np.zeros(len(w), bool)
    again[1:] = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
    h2, one = w.windows(2)
    cols = [
        np.log1p(size), np.log1p(w.count), mean, np.sqrt(np.maximum(by_word(length * length) / count - mean * mean, 0)),
        *(by_byte(_members(c)) for c in _CLASSES),
        *(by_word(x) / count for x in (upper[first], no_lower, stop[last], ~plain[last] & ~stop[last], ~plain[first], length <= 3, length >= 12, again)),
        *repetition(w.h, w.doc), *repetition(h2[one], w.doc[: len(h2)][one]),
    ]
    return np.stack([np.asarray(c, np.float32) for c in cols], 1)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "t")
        for lo, hi in slices(texts):
            x = statistics(texts.slice(lo, hi - lo))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([column(batch, "row").slice(lo, hi - lo), column(batch, "id").slice(lo, hi - lo), column(batch, "pick").slice(lo, hi - lo), values], ["row", "id", "pick", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of squares of a partition, as one row."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            yield _sum_row(0, np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))


def _sum_row(fold: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([values.tobytes()], pa.binary())], ["fold", "m"])


class Model:
    """cosines, the ridge weights of the final fit and of each fold, and the calibration."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.by_fold: dict[int, np.ndarray] = {}
        self.steps: np.ndarray | None = None

    def z(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.concatenate([np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.z(x) @ self.weights, LOW, HIGH)
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        # A hundredth of the raw score orders the texts that the isotonic steps tie.
        return np.clip(0.99 * np.interp(raw, centres, self.steps) + 0.01 * (raw - LOW) / (HIGH - LOW), 0, 1)


def _sums(model) -> object:
    """Normal equations by fold, one row for each fold of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = model.value, {}
        for batch in batches:
            fold = column(batch, "fold").to_numpy()
            z, y = m.z(_matrix(batch)), column(batch, "y").to_numpy()
            for f in np.unique(fold):
                own = np.concatenate([z[fold == f], y[fold == f, None]], 1)
                total[f] = total.get(f, 0) + own.T @ own
        for f, x in total.items():
            yield _sum_row(f, x)

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["m"])
    return pa.table({"fold": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})


def _apply(model, by_fold: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if by_fold:
                fold, z = column(batch, "fold").to_numpy(), m.z(_matrix(batch)) if batch.num_rows else np.zeros((0, 1))
                raw = np.array([z[k] @ m.by_fold[f] for k, f in enumerate(fold)], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)), column(batch, "y")], ["bin", "y"])
            else:
                score = m.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(score, pa.float64())], ["row", "score"])

    return run


def _score_texts(model) -> object:
    """Statistics and score in one pass, so one Python worker serves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                score = model.value.score(statistics(texts.slice(lo, hi - lo)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([column(batch, "row").slice(lo, hi - lo), pa.array(score, pa.float64())], ["row", "score"])

    return run


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means of bins with n rows that sum to y; empty bins take a neighbour's."""
    pools: list[list[float]] = []  # weight, sum, last bin
    for k in np.flatnonzero(n):
        pools.append([float(n[k]), float(y[k]), int(k)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], a[2]]
    out = np.empty(len(n))
    at = 0
    for weight, total, last in pools:
        out[at : last + 1] = total / weight
        at = last + 1
    out[at:] = out[at - 1] if at else 0.5
    return out


def score_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", id: str = "doc_id", label: str = "quality", fold: Column | None = None, learn: Column | None = None, keep: Sequence[str] = ("doc_id",), features: int = 256, width: float = 1.0, ridge: float = 1e-3, max_labelled: int = 300_000, seed: int = 7) -> DataFrame:
    """One row for each document row: row (struct of the kept columns) and score.

    fold: expression on column ``id`` that deals labelled rows to a few folds for the calibration; learn: whether a label of this ``id`` may be learned from.
    """
    spark = ship(docs.sparkSession)
    fold = F.crc32(F.col("id").cast("string")) % 5 if fold is None else fold
    learn = F.lit(True) if learn is None else learn
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`"), F.lit(seed)).alias("pick"), F.col(f"`{text}`").alias("t"))
    row, kind = (docs.schema[c].dataType.simpleString() for c in ("row", "id"))
    fields = f"row {row}, id {kind}, pick bigint, x array<float>"
    # Texts are not written with the statistics: where they are kept, the last step finds their statistics again.
    again = text in keep
    first_pass = docs.withColumn("row", F.lit(None).cast(docs.schema["row"].dataType)) if again else docs
    stats = written(first_pass.mapInArrow(lean(_featurise), fields), "statistics")
    rows = docs if again else stats
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    known = known.where(learn).withColumn("fold", fold.cast("long"))
    known = stats.drop("row").join(known, "id")
    n = known.count()
    if n > max_labelled:
        known = known.where(F.col("pick") < F.lit(int(-(2**63) + 2**64 * (max_labelled / n))))
    known = written(known.select("x", "y", "fold"), "labelled")
    part = known.mapInArrow(_moments, "fold bigint, m binary").groupBy("fold").applyInArrow(_add, "fold bigint, m binary").collect()  # one row
    if not part:
        return rows.select("row", F.lit(0.5).alias("score"))
    total = np.frombuffer(part[0]["m"])
    mean, square = total[1:].reshape(2, -1) / total[0]
    model = Model(mean, np.sqrt(np.maximum(square - mean * mean, 0)), features, width, seed)
    sums = known.mapInArrow(_sums(spark.sparkContext.broadcast(model)), "fold bigint, m binary").groupBy("fold").applyInArrow(_add, "fold bigint, m binary").collect()
    gram = {r["fold"]: np.frombuffer(r["m"]).reshape(features + 2, features + 2) for r in sums}  # as many as there are folds, of a fixed size

    def solve(x: np.ndarray) -> np.ndarray:
        a = x[:-1, :-1] + ridge * max(x[-2, -2], 1) * np.diag([*[1.0] * features, 0.0])
        return np.linalg.solve(a + 1e-9 * np.eye(features + 1), x[:-1, -1])

    total = sum(gram.values())
    model.weights = solve(total)
    model.by_fold = {f: solve(total - x if len(gram) > 1 else total) for f, x in gram.items()}
    bins = known.mapInArrow(_apply(spark.sparkContext.broadcast(model), True), "bin bigint, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # BINS rows at most
    count, ones = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        count[r["bin"]], ones[r["bin"]] = r["n"], r["y"]
    model.steps = isotonic(count, ones)
    final = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(lean(_score_texts(final) if again else _apply(final, False)), f"row {row}, score double")

