import math
import random

import numpy as np
from pyspark.sql import functions as F
from quillspark.llm.ann import build, nearest


def brute(rows, k):
    good = [(r, i, np.array(v, float)) for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for r, i, v in good:
        if i % 100 == 0:
            near = sorted((math.sqrt(((v - w) ** 2).sum()), j) for s, j, w in good if s != r and len(w) == len(v))[:k]
            out.setdefault(i, []).append([(j, round(d, 6)) for d, j in near])
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    return out


SCHEMA = "vec_id bigint, embedding array<float>"


def test_recall_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.standard_normal((3000, 24))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = result(nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, shard_rows=700))
    wanted = brute(rows, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q][0]}) for q in wanted)
    assert hits / (10 * len(wanted)) > 0.97 and all(len(v) == 10 for v in got.values())


def test_odd_input_and_ties(spark):
    rng = random.Random(2)
    rows = [(k, [float(k % 7), 1.0, 2.0]) for k in range(60, 130)] + [(100, [0.5, 0.5, 0.5]), (200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (700, []), (None, [1.0, 1.0, 1.0]), (800, [1.0, 2.0]), (801, [2.0, 2.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA + ", score string, rid string").coalesce(1)
    out = nearest(df, F.col("id") % 100 == 0, shard_rows=40)
    wanted = brute(rows, 10)
    got = result(out)
    assert got[800] == wanted[800][0] == [(801, 1.0)]
    assert sorted(got) == [100, 800] and sorted(got[100]) == sorted(x for part in wanted[100] for x in part)
    assert nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    rows = [(k, [1.0, 2.0]) for k in range(3000)] + [(5000, [1.0, 2.5])]
    got = result(nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0, shard_rows=500))
    assert got[0] == [(k, 0.0) for k in range(1, 11)]


def test_layers_are_prefixes():
    x = np.random.default_rng(3).standard_normal((900, 8))
    order, g = build(x, links=8, ef=32)
    assert sorted(order) == list(range(900)) and len(g.layers[0]) == 900
    for n, layer in enumerate(g.layers):
        assert layer.max() < len(layer) and layer.shape[1] == (16 if n == 0 else 8)
        assert all(len({*row[row >= 0]}) == (row >= 0).sum() and k not in row for k, row in enumerate(layer))
