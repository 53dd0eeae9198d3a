"""The rule engine: documents to findings."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.regex import LIKE_ASCII, WORD, anchors, quote
from quillspark.functions.text import cut_sql, let, line_starts, place_of, placed_sql
from quillspark.operators.rules import BUILTIN, Rule, load_rules
from quillspark.operators.segments import CANDIDATE, DETECTORS, sentences


def exception_pattern(exceptions: Sequence[str]) -> str:
    """Any of these as a whole word or phrase, in either case."""
    edge = rf"[{WORD}'\x{{2019}}]"
    return rf"(?iu)(?<!{edge})(?:{'|'.join(quote(x) for x in exceptions)})(?!{edge})"


def candidates(rule: Rule, found: Column) -> Column:
    """A rule's matches, without those whose own context holds one of its exceptions."""
    if not rule.named:
        found = F.transform(found, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["text"].alias("context")))
    found = F.coalesce(found, F.array().cast(CANDIDATE))
    if rule.exceptions:
        found = F.filter(found, lambda c: ~c["context"].rlike(exception_pattern(rule.exceptions)))
    return found


def audit(docs: DataFrame, rules: Sequence[Rule], *, keys: Sequence[str] = ("doc_id",), text: str = "text", positions: bool = True) -> DataFrame:
    """One row for each finding: the keys, rule_id, severity, message, matched_text, char_offset and, if asked for, line and column.

    Each rule's pattern runs once over a text, and lines are found by bisection, all in the text's own row; the findings
    that are exploded carry numbers of rules, and no text.
    """
    names = [f"_k{n}" for n in range(len(keys))]  # keys may be called as columns here are
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    none = F.lit(None)
    if any(r.named and r.detector in ("repeated_openings", "negative_listing", "manufactured_staccato") for r in rules):
        none = F.col("_spans")
        rows = rows.withColumn("_spans", sentences(F.col("_text")))
    odd = " or ".join(f"contains(_text, '{x}')" for x in LIKE_ASCII)
    rows = rows.withColumn("_low", F.expr(f"if({odd}, null, lower(_text))"))
    # Cut texts are columns of their own, used twice below, so the optimiser leaves each pattern at one evaluation.
    rows = rows.withColumns({f"_p{n}": F.expr(_guarded(r)) for n, r in enumerate(rules) if not r.named})
    # SQL for what is said for each rule: built call by call, a rule set takes the driver many seconds.
    plain = [f"transform({placed_sql(f'_p{n}')}, c -> named_struct('rule', {n}, 'matched_text', c.text, 'char_offset', c.start))" for n, r in enumerate(rules) if not r.named and not r.exceptions]
    every = F.expr(f"concat({', '.join(['cast(array() as array<struct<rule:int,matched_text:string,char_offset:int>>)', *plain])})")

    def found(n: int, rule: Rule) -> Column:
        own = DETECTORS[rule.detector](F.col("_text"), none) if rule.named else F.expr(placed_sql(f"_p{n}"))
        return F.transform(candidates(rule, own), lambda c: F.struct(F.lit(n).alias("rule"), c["text"].alias("matched_text"), c["start"].alias("char_offset")))

    rows = rows.select(*names, "_text", F.concat(every, *(found(n, r) for n, r in enumerate(rules) if r.named or r.exceptions)).alias("_found"))
    if positions:
        rows = rows.withColumn("_starts", F.when(F.size("_found") > 0, line_starts(F.col("_text"))))
        rows = rows.withColumn("_found", F.transform("_found", lambda f: let(place_of(F.col("_starts"), f["char_offset"]), lambda p: f.withField("line", p["line"]).withField("column", p["column"]))))
    # explode_outer, as Spark guards explode with a filter that evaluates what is exploded a second time.
    out = rows.select(*names, F.explode_outer("_found").alias("f")).where("f is not null").select(*names, "f.*")
    each = lambda values: F.expr(f"get(array({', '.join(map(_quoted, values))}), rule)") if rules else F.lit("")
    about = [each([r.id for r in rules]).alias("rule_id"), each([r.severity for r in rules]).alias("severity"), each([r.message for r in rules]).alias("message")]
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *about, "matched_text", "char_offset", *(["line", "column"] if positions else []))


def _guarded(rule: Rule) -> str:
    """A text (_text) cut at a rule's matches, as SQL. The pattern runs only where the text in lower case (_low) holds what each match holds: looking for fixed texts takes a small part of a pattern's time."""
    cut = cut_sql("_text", rule.java)
    needed = " and ".join(f"({' or '.join(f'contains(_low, {_quoted(x)})' for x in one)})" for one in anchors(rule.detector))
    return f"if(coalesce({needed}, true), {cut}, array(_text))" if needed else cut


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Auditor:
    """Rules that are loaded once and applied to many tables."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)

    @classmethod
    def from_file(cls, path: str | Path = BUILTIN) -> Auditor:
        return cls(load_rules(path))

    def audit(self, docs: DataFrame, **how) -> DataFrame:
        return audit(docs, self.rules, **how)


def ordered(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """In source order."""
    return findings.orderBy(*keys, "char_offset", "rule_id")


def tell_rate(findings: Column, words: Column) -> Column:
    """Findings per 1,000 words; 0 without words."""
    return F.when(words <= 0, F.lit(0.0)).otherwise(findings * F.lit(1000.0) / words)


def mark_within_allowance(findings: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds within_allowance: the earliest findings of each rule, up to its allowance for the document."""
    place = F.row_number().over(Window.partitionBy(*keys, "rule_id").orderBy("line", "column"))
    known = baseline.select(*keys, "rule_id", "allowance")
    return findings.join(known, [*keys, "rule_id"], "left").withColumn("within_allowance", place <= F.coalesce("allowance", F.lit(0))).drop("allowance")
