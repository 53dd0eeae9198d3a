import os
import random

import numpy as np
import pytest
from quillspark.cluster import noting
from quillspark.llm.components import components
from quillspark.llm.minhash import _neighbours, near_duplicates, shingle_sets, signatures

from tests.llm.helpers import empty_documents, lower, odd_documents, plain_words, text, thue_morse


def shingles(t, n):
    w = plain_words(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    cells = np.zeros((len(docs), len(words)), np.float32)
    for k, own in enumerate(sets):
        cells[k, [words[g] for g in own]] = 1
    size = cells.sum(1)
    for lo in range(0, len(docs), 500):
        both = cells[lo : lo + 500] @ cells.T
        for a, b in np.argwhere((both > 0) & (100 * both >= percent * (size[lo : lo + 500, None] + size - both))).tolist():
            a += lo
            root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(docs))


def edited(rng, t, share):
    return " ".join(rng.choice("uvwxyz") + str(rng.random()) if rng.random() < share else w for w in t.split())


def result(df):
    return sorted((r["id"], r["size"], r["component"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80), (1, 100)])
def test_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    docs = []
    for k in range(40):
        t = text(rng, rng.randrange(1, 120))
        docs.append((1000 - len(docs), t))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            docs.append((1000 - len(docs), edited(rng, t, rng.choice([0.0, 0.01, 0.02, 0.04, 0.2])).upper() if k % 2 else edited(rng, t, 0.02)))
    docs += [(5000, "one"), (5001, "ONE"), (5002, "one two"), (5003, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert result(near_duplicates(df, shingle=n, percent=percent)) == brute(docs, n, percent)


def test_many_copies_of_one_original(spark):
    """Copies linked with their original only, not with each other: a star of thousands."""
    rng = random.Random(11)
    base = text(rng, 120)
    docs = [(10_000, base)] + [(k, edited(rng, base, 0.022)) for k in range(2500)] + [(20_000 + k, text(rng, 150)) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert result(near_duplicates(df, shingle=3, percent=85)) == brute(docs, 3, 85)


def test_words_in_thue_morse_order_are_not_taken_for_equal(spark):
    one, other = thue_morse(2048)
    df = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id bigint, text string")
    assert result(near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_odd_input(spark):
    out = near_duplicates(odd_documents(spark), keep=["doc_id", "size"]).collect()
    by = sorted(((r["id"], r["size"], r["component"], r["kept"]) for r in out), key=str)
    assert len(out) == 9 and {r["row"]["size"] for r in out} == {"own"}
    assert (1, 1, 1, True) in by and (2, 0, 2, True) in by and (None, 1, None, True) in by
    assert [x[2:] for x in by if x[0] in (5, 6)] == [(5, True), (5, False)]
    assert near_duplicates(empty_documents(spark)).count() == 0
    cols = odd_documents(spark).columns
    kept = near_duplicates(odd_documents(spark), keep=cols).collect()
    assert sorted(((r["id"], r["size"], r["component"], r["kept"]) for r in kept), key=str) == by


def test_signatures_estimate_similarity():
    import pyarrow as pa

    rng = random.Random(3)
    base = text(rng, 400)
    doc, h, size, keys = shingle_sets(pa.array([base, edited(rng, base, 0.05), base]), 3)
    s = signatures(doc, h, size, 512)
    a, b = shingles(base, 3), {int(x) for x in h[doc == 1]}
    true = len({int(x) for x in h[doc == 0]} & b) / len({int(x) for x in h[doc == 0]} | b)
    assert len(a) == size[0] and abs((s[0] == s[1]).mean() - true) < 0.08
    assert (keys[:, 0] == keys[:, 2]).all() and (keys[:, 0] != keys[:, 1]).any()


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(len(root)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shares_are_of_distinct_shingles():
    import pyarrow as pa

    _, _, size, _ = shingle_sets(pa.array(["a a a a a a", "a b a b a b", None, "x"]), 3)
    assert size.tolist() == [1, 2, 0, 1] and size.dtype == np.int64


def dealt(rows, depth):
    """Batches of sorted rows (order, part of the signature, node), cut after two thirds."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([np.array(r[1], ">u4").tobytes() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["o", "p", "node"])

    cut = len(rows) * 2 // 3
    return iter([batch(rows[:cut]), batch(rows[cut:])])


def test_regions_are_whole_across_batches_and_ends():
    reach, rows = 2, [(0, (1, k), 10 + k) for k in range(3)] + [(0, (2, k), 20 + k) for k in range(4)] + [(0, (3, k), 30 + k) for k in range(6)] + [(0, (4, 0), 40)]
    for cut in (rows, rows[3:13], rows[5:]):
        out = [r for b in _neighbours(2, 1, reach)(dealt(cut, 2)) for r in b.to_pylist()]
        pairs, members = {(r["a"], r["b"]) for r in out if r["kind"] == 0}, {r["a"] for r in out if r["kind"] == 1}
        assert {n for _, _, n in cut if 30 <= n < 40} <= members  # large, whatever batch its rows came in
        assert {cut[0][2], cut[-1][2]} <= members  # may go on in another partition
        inner = [n for _, _, n in cut if 20 <= n < 30]
        assert {(a, b) for a in inner for b in inner if a < b} <= pairs or cut[0][2] in inner  # a small region: all pairs


def test_pairs_within_a_hot_group(spark):
    """Hundreds of texts of one template, at 0.7 to each other, some with one partner above the threshold."""
    rng = random.Random(12)
    base, docs = text(rng, 200), []
    for k in range(900):
        t = edited(rng, base, 0.03)
        docs.append((len(docs), t))
        if k % 3 == 0:
            docs.append((len(docs), edited(rng, t, 0.022)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    wanted = brute(docs, 3, 85)
    assert result(near_duplicates(df, shingle=3, percent=85)) == wanted
    assert result(near_duplicates(df, shingle=3, percent=85, block=30_000)) == wanted  # many blocks


def test_rows_with_a_regions_common_values_weigh_most():
    rows = [(0, (1, 5), 10 + k) for k in range(4)] + [(0, (1, 6 + k), 20 + k) for k in range(5)]
    weight = {r["a"]: r["v"] for b in _neighbours(2, 1, 2)(dealt(rows, 2)) for r in b.to_pylist() if r["kind"] == 1}
    assert min(weight[10 + k] for k in range(4)) > max(weight[20 + k] for k in range(5)) > 0


def test_signatures_go_when_they_have_been_sorted(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(n, text(rng, 30)) for n in range(20)] * 2, "doc_id bigint, text string")
    with noting() as paths:
        out = near_duplicates(docs).collect()
    kept = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert len(out) == 40 and sum(r["kept"] for r in out) == 40 and {r["component"] for r in out} == set(range(20))
    assert any("/sets-" in p for p in kept) and not any("/forest-" in p for p in kept)
