import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from quillspark.llm.quality import isotonic, score_quality, statistics

from tests.llm.helpers import empty_documents, odd_documents, plain_words, text


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        good = k % 3 > 0
        t = text(rng, rng.randrange(20, 200))
        rows.append((k, t + "." if good else rng.choice([t.upper() + "!!", " | ".join(t.split()), (t.split()[0] + " ") * 90]), int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    fold = F.crc32(F.col("id").cast("string")) % 5
    out = score_quality(docs, docs, fold=fold, learn=fold != 0, max_labelled=10_000).toPandas()
    got = {r.row["doc_id"]: r.score for r in out.itertuples()}
    held = [(got[k], q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    score, y = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, y) > 0.99 and ((score >= 0.3) == (y == 1)).mean() > 0.97
    assert ((out.score >= 0) & (out.score <= 1)).all()


def test_the_bound_on_labelled_rows_holds_and_scores_all(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, text(rng, 30) if k % 2 else text(rng, 30).upper(), k % 2) for k in range(600)], "doc_id bigint, text string, quality int")
    out = score_quality(docs, docs, max_labelled=150).toPandas()
    assert len(out) == 600
    y = np.array([r["doc_id"] % 2 for r in out["row"]])
    assert auc(out.score.to_numpy(), y) > 0.95


def test_odd_input(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, None), (7, 0, 1), (None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = score_quality(odd_documents(spark), labels, keep=["doc_id", "score"]).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out) and out[0]["row"]["score"] == "own"
    assert {r["score"] for r in score_quality(odd_documents(spark), labels.limit(0)).collect()} == {0.5}
    assert score_quality(empty_documents(spark), labels).count() == 0
    kept = score_quality(odd_documents(spark), labels, keep=odd_documents(spark).columns)
    assert sorted((r["row"]["doc_id"] or 0, round(r["score"], 9)) for r in kept.collect()) == sorted((r["row"]["doc_id"] or 0, round(r["score"], 9)) for r in out)
    ones = score_quality(odd_documents(spark), labels.where("doc_id = 5"))
    assert min(r["score"] for r in ones.collect()) > 0.9


def test_isotonic_is_the_best_monotone_fit():
    n, y = np.array([1, 2, 0, 1, 3, 1]), np.array([1.0, 0.0, 0.0, 1.0, 2.0, 1.0])
    fit = isotonic(n, y)
    assert (np.diff(fit) >= 0).all()
    assert np.allclose(fit, [1 / 3, 1 / 3, 0.75, 0.75, 0.75, 1.0])


def test_statistics_of_nothing():
    import pyarrow as pa

    x = statistics(pa.array(["", None, "a"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def plain_statistics(t):
    """The statistics from their definitions, a text and a word at a time."""
    raw = (t or "").encode()
    words = [w.encode() for w in plain_words(t)]
    letters, small, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
    classes = [letters, small, digits, b".", b",;:", b"!?", b"#$%&*@^~+=<>_\\", b"|", b"()[]{}", b"\"'`", b"-/", b"\n", bytes(range(128, 256))]
    plain = letters + small + digits + bytes(range(128, 256))
    n, size = max(len(words), 1), [len(w) for w in words]
    mean = sum(size) / n
    out = [math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in size) / n - mean * mean, 0))]
    out += [sum(c in k for c in raw) / max(len(raw), 1) for k in classes]
    out.append(sum(w[0] in letters for w in words) / n)
    out.append(sum(w[0] in letters and not any(c in small for c in w) for w in words) / n)
    out.append(sum(w[-1] in b".!?" for w in words) / n)
    out.append(sum(w[-1] not in plain and w[-1] not in b".!?" for w in words) / n)
    out.append(sum(w[0] not in plain for w in words) / n)
    out += [sum(x <= 3 for x in size) / n, sum(x >= 12 for x in size) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
    for grams in (words, list(zip(words, words[1:], strict=False))):
        times, total = collections.Counter(grams), max(len(grams), 1)
        out += [len(times) / total, math.log1p(len(times)) / math.log1p(total + 1), max(times.values(), default=0) / total, sum(v == 1 for v in times.values()) / total, sum(v * math.log(v) for v in times.values()) / total / math.log1p(total)]
    return out


def texts_of_all_kinds(rng, n):
    kinds = [lambda t: t + ".", lambda t: t.upper() + "!!", lambda t: " | ".join(t.split()), lambda t: (t.split()[0] + " ") * 30, lambda t: t.replace("a", "ä"), lambda t: t.title().replace(" ", "\n"), lambda t: f"({t}) # {t} - 12/3"]
    return [rng.choice(kinds)(text(rng, rng.randrange(1, 60))) for _ in range(n)]


def test_statistics_equal_their_definitions():
    import pyarrow as pa

    values = [None, "", " \n", "A", "aa aa aa", "Ünï CODE — \U0001f600 x", *texts_of_all_kinds(random.Random(4), 200)]
    got = statistics(pa.array(values, pa.string()))
    assert np.allclose(got, np.array([plain_statistics(t) for t in values]), rtol=1e-5, atol=1e-6)


def test_scores_equal_a_plain_fit(spark):
    """Features, ridge, calibration and scores again, on whole matrices and without partial sums."""
    rng = random.Random(9)
    values = texts_of_all_kinds(rng, 260)
    labels = [int(len(set(t.split())) > 12) if rng.random() < 0.9 else rng.randrange(2) for t in values]
    docs = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(values, labels, strict=True))], "doc_id bigint, text string, quality int").repartition(5)
    fold = np.array([zlib.crc32(str(k).encode()) % 5 for k in range(len(values))])
    where = F.crc32(F.col("id").cast("string")) % 5
    out = {r["row"]["doc_id"]: r["score"] for r in score_quality(docs, docs, fold=where, learn=where != 0, features=40).collect()}

    x = np.array([plain_statistics(t) for t in values]).astype(np.float32).astype(np.float64)
    known = fold != 0
    mean, sd = x[known].mean(0), x[known].std(0)
    draw = np.random.default_rng(7)
    w, b = draw.standard_normal((x.shape[1], 40)) / np.sqrt(x.shape[1]), draw.uniform(0, 2 * np.pi, 40)
    z = np.concatenate([np.cos(np.clip((x - mean) / np.where(sd > 1e-9, sd, 1), -8, 8) @ w + b) * np.sqrt(2 / 40), np.ones((len(x), 1))], 1)
    y = np.array(labels, float)

    def ridge(rows):
        much = np.sqrt(1e-3 * rows.sum())
        a = np.concatenate([z[rows], much * np.eye(41)[:40]])
        return np.linalg.lstsq(a, np.concatenate([y[rows], np.zeros(40)]), rcond=None)[0]

    bins, sums = np.zeros(2000), np.zeros(2000)
    for f in range(1, 5):
        raw = z[fold == f] @ ridge(known & (fold != f))
        for r, v in zip(raw, y[fold == f], strict=True):
            k = int(np.clip((r + 0.5) / 2 * 2000, 0, 1999))
            bins[k], sums[k] = bins[k] + 1, sums[k] + v
    own = np.flatnonzero(bins)
    total, count = np.append(0, np.cumsum(sums[own])), np.append(0, np.cumsum(bins[own]))
    fit = [max(min((total[j + 1] - total[i]) / (count[j + 1] - count[i]) for j in range(k, len(own))) for i in range(k + 1)) for k in range(len(own))]
    steps = np.array(fit)[np.minimum(np.searchsorted(own, np.arange(2000)), len(own) - 1)]
    raw = np.clip(z @ ridge(known), -0.5, 1.5)
    wanted = np.clip(0.99 * np.interp(raw, -0.5 + (np.arange(2000) + 0.5) / 1000, steps) + 0.01 * (raw + 0.5) / 2, 0, 1)
    got = np.array([out[k] for k in range(len(values))])
    assert np.abs(got - wanted).max() < 5e-3 and np.median(np.abs(got - wanted)) < 1e-6
