"""Repeat runs, noise floors, comparisons of systems and the decision gate, on long tables of metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import token_count
from quillspark.operators.findings import audit, tell_rate
from quillspark.operators.metrics import token_counts, token_l2
from quillspark.operators.rules import Rule

# The gate's limits.
MIN_WORDS, MIN_SHARE, RUNS_FOR_FLOOR = 50, 0.30, 5
REPORT_METRICS = ["tell_rate", "token_1gram_l2", "mean_sentence_length", "sentence_length_variance", "repeated_opening_rate"]


def long_metrics(reports: DataFrame, keys: Sequence[str], metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """keys, metric, value."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return reports.select(*keys, each.alias("m")).select(*keys, "m.*")


def check_runs(runs: DataFrame) -> None:
    """Two runs at least, each with the same systems and metrics. runs: run, system, metric, value."""
    n = runs.select("run").distinct().count()
    if n < 2:
        raise ValueError("repeat runs need at least 2 runs")
    uneven = runs.select("run", "system", "metric").distinct().groupBy("system", "metric").agg(F.count("*").alias("n")).where(F.col("n") != n).orderBy("system", "metric").first()
    if uneven:
        raise ValueError(f"inconsistent systems or metrics across runs: {uneven['system']!r} has {uneven['metric']!r} in {uneven['n']} of {n} runs")


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """system, metric, min, max, mean, stddev (of the population), spread, n_runs, n_null."""
    value = F.col("value")
    return runs.groupBy("system", "metric").agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), (F.max(value) - F.min(value)).alias("spread"),
        F.count(value).alias("n_runs"), F.count_if(value.isNull()).alias("n_null"),
    )


def noise_floor(aggregate: DataFrame) -> DataFrame:
    """metric, floor (the largest spread), system (the first of that spread), n_runs_min, bound_only."""
    some = F.col("spread").isNotNull()
    out = aggregate.groupBy("metric").agg(F.max("spread").alias("floor"), F.min_by(F.when(some, F.col("system")), F.when(some, F.struct(-F.col("spread"), F.col("system")))).alias("system"), F.min("n_runs").alias("n_runs_min"))
    return out.withColumn("bound_only", F.col("n_runs_min") < RUNS_FOR_FLOOR)


def verdict(delta: Column, floor: Column) -> Column:
    return F.when(delta.isNull(), "undefined").when(floor.isNull(), "no_floor").when(F.abs(delta) <= floor, "inconclusive_below_noise_floor").otherwise("actionable")


def compare_systems(metrics: DataFrame, a: str, b: str, floor: DataFrame | None = None) -> DataFrame:
    """metric, value_a, value_b, delta, verdict. metrics: system, metric, value."""
    left, right = (metrics.where(F.col("system") == s).select("metric", F.col("value").alias(f"value_{k}")) for k, s in (("a", a), ("b", b)))
    both = left.join(right, "metric", "full_outer")
    both = both.withColumn("delta", F.col("value_b") - F.col("value_a"))
    both = both.join(floor.select("metric", "floor"), "metric", "left") if floor is not None else both.withColumn("floor", F.lit(None).cast("double"))
    return both.select("metric", "value_a", "value_b", "delta", verdict(F.col("delta"), F.col("floor")).alias("verdict"))


def record_l2(records: DataFrame, reference: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, l2 for each record: null for records without tokens."""
    found = token_l2(token_counts(records, (id,)), reference, (id,))
    return records.select(id).join(found, id, "left")


def decision_gate(current: DataFrame, audited: DataFrame, reference: DataFrame, rules: Sequence[Rule], l2_floor: float | None, tell_rate_threshold: float = 2.0, eval_words: DataFrame | None = None, id: str = "doc_id", order: str | None = None) -> DataFrame:
    """criterion, measured, compared_with, status, label, measures (all that was measured, by name), verdict: a row for each criterion.

    1 no warn finding; 2 tell rate; 3 mean distance of records against the current system's; 4 no
    record without a distance; 5 (with eval_words: id, word_count) length.
    """
    counts = token_counts(reference)
    found = audit(audited, rules, keys=(id,), positions=False).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "warn").alias("warns"))
    words = audited.select(*dict.fromkeys([id, order or id]), token_count(F.col("text")).alias("words"))
    total = words.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    sums = {k: record_l2(x, counts, id).agg(F.avg("l2").alias(f"mean_{k}"), F.count_if(F.col("l2").isNull()).alias(f"null_{k}")) for k, x in (("audited", audited), ("current", current))}
    one = found.crossJoin(total).crossJoin(sums["audited"]).crossJoin(sums["current"])  # one row each
    rate = tell_rate(F.col("findings"), F.col("words"))
    delta, floor = F.col("mean_audited") - F.col("mean_current"), F.lit(l2_floor).cast("double")
    third = F.when(floor.isNull(), "blocked").when(delta.isNull(), "fail").when(delta <= floor, "pass").otherwise("fail")
    label = F.when(delta.isNull() | floor.isNull(), "n/a").when(F.abs(delta) <= floor, "inconclusive").otherwise("conclusive")
    nulls = F.col("null_audited") + F.col("null_current")

    def row(n: int, measured: Column, against: Column, status: Column, label: Column | None = None, **measures: Column) -> Column:
        named = F.create_map(*(x for k, v in measures.items() for x in (F.lit(k), v.cast("double"))))
        return F.struct(F.lit(n).alias("criterion"), measured.cast("double").alias("measured"), against.cast("double").alias("compared_with"), status.alias("status"), (F.lit(None).cast("string") if label is None else label).alias("label"), named.alias("measures"))

    def passes(ok: Column) -> Column:
        return F.when(ok, "pass").otherwise("fail")

    rows = [
        row(1, F.col("warns"), F.lit(0), passes(F.col("warns") == 0), warn_finding_count=F.col("warns")),
        row(2, rate, F.lit(tell_rate_threshold), passes((F.col("words") > 0) & (rate <= tell_rate_threshold)), tell_rate=rate, word_count=F.col("words"), finding_count=F.col("findings"), threshold=F.lit(tell_rate_threshold)),
        row(3, delta, floor, third, label, mean_l2_audited=F.col("mean_audited"), mean_l2_current=F.col("mean_current"), delta=delta, noise_floor=floor),
        row(4, nulls, F.lit(0), passes(nulls == 0), n_null_current=F.col("null_current"), n_null_audited=F.col("null_audited")),
    ]
    if eval_words is not None:
        needed = words.join(eval_words.select(id, "word_count"), id, "left")
        least = F.greatest(F.lit(float(MIN_WORDS)), F.coalesce(F.lit(MIN_SHARE) * F.col("word_count"), F.lit(0.0)))
        short = needed.agg(F.count("*").alias("records"), F.count_if(F.col("words") < least).alias("short"), F.min_by(id, F.struct("words", order or id)).cast("string").alias("shortest"), F.coalesce(F.min("words"), F.lit(0)).alias("fewest"))
        one = one.crossJoin(short)
        rows.append(row(5, F.col("short"), F.lit(0), passes(F.col("short") == 0), F.coalesce("shortest", F.lit("n/a")), record_count=F.col("records"), below_threshold_count=F.col("short"), min_words=F.lit(MIN_WORDS), reference_fraction=F.lit(MIN_SHARE), shortest_words=F.col("fewest")))
    table = one.select(F.array(*rows).alias("rows"))
    final = F.when(F.exists("rows", lambda r: r["status"] == "fail"), "insufficient").when(F.exists("rows", lambda r: r["status"] == "blocked"), "blocked").otherwise("sufficient")
    return table.select(final.alias("verdict"), F.explode("rows").alias("r")).select("r.*", "verdict")
