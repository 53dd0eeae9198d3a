"""The report of a corpus: one row for each system, from one pass over its documents and one over its tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import token_count
from quillspark.operators import metrics as m
from quillspark.operators.findings import audit, tell_rate
from quillspark.operators.rules import Rule, fingerprint


def finding_counts(findings: DataFrame, system: str) -> DataFrame:
    """system, finding_count and maps of counts by severity and by rule."""
    by_rule = findings.groupBy(system, "rule_id", "severity").agg(F.count("*").alias("n"))
    rules = F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "n"))))
    severities = F.filter(F.array(*(F.struct(F.lit(s).alias("severity"), F.sum(F.when(F.col("severity") == s, F.col("n"))).alias("n")) for s in ("info", "warn"))), lambda x: x["n"].isNotNull())
    return by_rule.groupBy(system).agg(F.sum("n").alias("finding_count"), F.map_from_entries(severities).alias("findings_by_severity"), rules.alias("findings_by_rule"))


def system_report(docs: DataFrame, reference: DataFrame, rules: Sequence[Rule], *, system: str = "system", order: str = "ord", text: str = "text", top: int = 10, diversity: bool = True) -> DataFrame:
    """One row for each system: counts, findings, metrics, quality metrics and overrepresented tokens.

    Sentence metrics are those of the system's documents joined in order; all else adds up over documents.
    """
    counts = m.token_counts(docs, (system,), text)
    words = m.token_counts(reference, (), text)
    sums = m.summed(m.joined_structure(docs, system, order, text), [system])
    every = docs.groupBy(system).agg(F.count("*").alias("document_count"))
    found = finding_counts(audit(docs, rules, keys=(system,), text=text, positions=False), system)
    over = m.top_overrepresented(counts, words, (system,), top).groupBy(system).agg(F.sort_array(F.collect_list(F.struct("rank", "token", "rate_difference"))).alias("o"))
    out = every.join(sums, system, "left").join(m.corpus_syllables(counts, (system,)), system, "left").join(m.token_l2(counts, words, (system,)), system, "left").join(found, system, "left").join(over, system, "left")
    if diversity:
        out = out.join(m.corpus_mtld(docs, system, order, text), system, "left")
    out = out.na.fill(0, [*m.COUNTERS, "syllables", "finding_count"])
    none = F.expr("cast(map() as map<string,bigint>)")
    return out.select(
        system, "document_count", F.col("words").alias("word_count"), "finding_count",
        F.coalesce("findings_by_severity", none).alias("findings_by_severity"), F.coalesce("findings_by_rule", none).alias("findings_by_rule"),
        F.transform_values(F.coalesce("findings_by_severity", none), lambda k, v: tell_rate(v, F.col("words"))).alias("tell_rates_by_severity"),
        tell_rate(F.col("finding_count"), F.col("words")).alias("tell_rate"), F.col("l2").alias("token_1gram_l2"),
        *(c.alias(k) for k, c in m.structure_metrics().items()), *(c.alias(k) for k, c in m.readability(F.col("words"), F.col("sentences"), F.col("syllables")).items()),
        *([F.col("mtld")] if diversity else []), *(c.alias(k) for k, c in m.paragraph_metrics().items()),
        F.transform(F.coalesce("o", F.array().cast("array<struct<rank:int,token:string,rate_difference:double>>")), lambda x: F.struct(x["token"].alias("token"), x["rate_difference"].alias("rate_difference"))).alias("top_overrepresented"),
    )


def provenance(reference: DataFrame, rules: Sequence[Rule], *, reference_path: str = "", rules_path: str = "", version=None, text: str = "text") -> dict:
    """Where a report's reference and rules come from. Digests are those of the files' bytes; None for what is no local file."""
    row = reference.agg(F.count("*").alias("n"), F.coalesce(F.sum(token_count(F.col(text))), F.lit(0)).alias("words")).first()
    return {
        "reference_corpus": {"path": reference_path, "record_count": row["n"], "word_count": row["words"], "sha256": _file_digest(reference_path)},
        "rule_set": {"path": rules_path, "version": version, "rule_count": len(rules), "sha256": _file_digest(rules_path), "fingerprint": fingerprint(rules)},
    }


def _file_digest(path: str) -> str | None:
    if not Path(path).is_file():
        return None
    with Path(path).open("rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
