"""The generate and revise loop around a model that the caller injects.

The model is called on the driver, one record after another, never on executors. Audits are
Spark jobs over the records that are still dirty; each round's records are written to the shared folder, so
a round starts from files.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import written
from quillspark.operators.corpus import generation_prompt, revision_prompt
from quillspark.operators.findings import audit
from quillspark.operators.literals import compare_literals
from quillspark.operators.rules import Rule

Model = Callable[[str], str]
#: Fixed value: revisions of a record at most.
ROUNDS = 2


class CallFailed(RuntimeError):
    """kind: timeout, nonzero_exit or empty_output."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def call(model: Model, prompt: str, pause: float = 0.0) -> str:
    """One answer, with one more try after a failure."""
    for attempt in (1, 2):
        try:
            answer = model(prompt)
            if not answer.strip():
                raise CallFailed("empty_output")
            return answer
        except CallFailed:
            if attempt == 2:
                raise
            time.sleep(pause)
    raise AssertionError


@dataclass
class Run:
    """records: id, text, status (generated, clean, revised), iterations. failures: id and kind."""

    records: DataFrame
    findings: DataFrame | None = None
    preservation: DataFrame | None = None
    failures: list[tuple[str, str]] = field(default_factory=list)


SCHEMA = "id string, text string, status string, iterations int"


def _take(rows: DataFrame, done: DataFrame | None, most: int | None) -> DataFrame:
    rows = rows if most is None else rows.orderBy("id").limit(most)
    return rows if done is None else rows.join(done.select("id"), "id", "left_anti")


def generate(prompts: DataFrame, model: Model, system_prompt: str, *, done: DataFrame | None = None, max_records: int | None = None) -> Run:
    """A text for each prompt (id, prompt); records that are done already stay as they are."""
    spark, out, failures = prompts.sparkSession, [], []
    asked = _take(prompts, done, max_records).select("id", generation_prompt(F.lit(system_prompt), F.col("prompt")).alias("p")).orderBy("id")
    for row in asked.toLocalIterator():
        try:
            out.append((row["id"], call(model, row["p"]), "generated", 0))
        except CallFailed as error:
            failures.append((row["id"], error.kind))
    records = spark.createDataFrame(out, SCHEMA)
    if done is not None:
        records = records.unionByName(done.select("id", "text", F.lit("kept").alias("status"), F.lit(0).alias("iterations")))
    return Run(written(records, "generated"), failures=failures)


def revise(prompts: DataFrame, source: DataFrame, rules: Sequence[Rule], model: Model, system_prompt: str, *, done: DataFrame | None = None, max_records: int | None = None, rounds: int = ROUNDS) -> Run:
    """Revise each source text (id, text) that a prompt names until no finding of severity warn is left, at most ``rounds`` times. Texts without one are copied."""
    absent = prompts.join(source, "id", "left_anti").orderBy("id").first()
    if absent:
        raise ValueError(f"no source text for {absent['id']!r}")
    spark = source.sparkSession
    chosen = _take(prompts.select("id"), done, max_records)
    records = written(source.join(chosen, "id", "left_semi").select("id", "text", F.lit("clean").alias("status"), F.lit(0).alias("iterations")), "revise")
    failures: list[tuple[str, str]] = []
    for n in range(1, rounds + 1):
        found = audit(records, rules, keys=("id",), positions=False)
        dirty = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("char_offset", "rule_id", "message", "matched_text"))).alias("f"), F.count_if(F.col("severity") == "warn").alias("warns")).where("warns > 0")
        asked = records.join(dirty, "id").select("id", revision_prompt(F.lit(system_prompt), F.col("f"), F.col("text")).alias("p")).orderBy("id")
        new, lost = [], []
        for row in asked.toLocalIterator():
            try:
                new.append((row["id"], call(model, row["p"]), "revised", n))
            except CallFailed as error:
                lost.append((row["id"], error.kind))
        if not new and not lost:
            break
        failures += lost
        gone = spark.createDataFrame([(x[0],) for x in [*new, *lost]], "id string")
        records = written(records.join(gone, "id", "left_anti").unionByName(spark.createDataFrame(new, SCHEMA)), "revise")
    if done is not None:
        records = records.unionByName(done.select("id", "text", F.lit("kept").alias("status"), F.lit(0).alias("iterations")))
    kept = source.join(records.select("id"), "id", "left_semi")
    return Run(records, audit(records, rules, keys=("id",)), compare_literals(kept, records, "id"), failures)
