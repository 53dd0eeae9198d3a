"""Each stage against brute force on its own input, the whole run, and odd input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import odd_documents
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_packing import check

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that each stage got and what it gave, as rows."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        f(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_stages_in_order(stages):
    assert [s[0] for s in stages] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    assert all(s[3] == COLUMNS for s in stages[:4])


def test_quality_keeps_good_documents(spark, stages):
    _, before, after, _ = stages[0]
    kept = {r["doc_id"] for r in after}
    assert [r for r in before if r["doc_id"] in kept] == sorted(after, key=lambda r: r["doc_id"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(k in kept for k in good) / len(good) > 0.97 and sum(k in kept for k in bad) / len(bad) < 0.35


def test_line_dedup_equals_brute_force(stages):
    _, before, after, _ = stages[1]
    wanted = [(int(k), t) for k, n, gone, t in brute_lines([(r["doc_id"], r["text"]) for r in before], 3, 60) if gone == 0 or gone < n]
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(wanted)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup_equals_brute_force(stages):
    _, before, after, _ = stages[2]
    wanted = {i for i, _, _, kept in brute_near([(r["doc_id"], r["text"]) for r in before], 5, 80) if kept}
    assert {r["doc_id"] for r in after} == wanted
    by = {r["doc_id"]: r for r in before}
    assert all(by[r["doc_id"]] == r for r in after)


def test_decontamination_equals_brute_force(spark, stages):
    _, before, after, _ = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {int(k) for k, _, hit, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before], items) if not hit}
    assert {r["doc_id"] for r in after} == clean < {r["doc_id"] for r in before}


def test_packing_is_whole(spark, stages):
    _, before, after, _ = stages[4]
    rows = [{"row": {"doc_id": r["doc_id"]}} | r.asDict() for r in after]
    check(rows, {r["doc_id"]: r["text"] for r in before}, 1024)


def test_run_gives_the_same_documents(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()
    assert {tuple(r) for r in rows} == {(r["doc_id"], r["doc_tokens"]) for r in stages[4][2]}


def test_odd_input(spark):
    odd = odd_documents(spark).withColumn("gone", F.lit("own"))
    for docs in (odd, odd.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            rows = out.collect()
            assert (out.columns == docs.columns) == (f is not corpus_pipeline.packing)
            assert rows or docs is not odd
