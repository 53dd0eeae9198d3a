"""Style profiles: statistics and counts of a corpus, kept as tables, and the gap and score of drafts against them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.cluster import written
from quillspark.functions.text import slug, token_count
from quillspark.operators import assess
from quillspark.operators import metrics as m
from quillspark.operators.corpus import subsamples
from quillspark.operators.findings import audit
from quillspark.operators.rules import Rule, fingerprint
from quillspark.operators.segments import opening_runs, sentences
from quillspark.sources.readers import InputError, clean_texts, read_json, read_records, read_texts, write_json, write_records

METRICS_VERSION = 1
#: Of assessments with a rule baseline.
ASSESSMENT_VERSION = 2


@dataclass(frozen=True)
class Profile:
    """A corpus as drafts are measured by it. statistics: one row; tokens: token, n; rules: rule_id, profile_count."""

    name: str
    words: int
    statistics: dict
    tokens: DataFrame
    rules: DataFrame


def statistics(texts: DataFrame, order: str = "ord", text: str = "text", diversity: bool = True) -> dict:
    """Metrics of a corpus, its paragraphs and its most frequent content words. diversity: whether lexical diversity is among them, which no score needs; else it is None."""
    docs = texts.withColumn("_system", F.lit("all"))
    counts = m.token_counts(docs, ("_system",), text).persist()
    try:
        sums = m.summed(m.joined_structure(docs, "_system", order, text), ["_system"]).join(m.corpus_syllables(counts, ("_system",)), "_system", "left")
        sums = sums.join(m.corpus_mtld(docs, "_system", order, text), "_system", "left") if diversity else sums.withColumn("mtld", F.lit(None).cast("double"))
        row = sums.select("words", *(c.alias(k) for k, c in m.structure_metrics().items()), *(c.alias(k) for k, c in m.readability(F.col("words"), F.col("sentences"), F.coalesce("syllables", F.lit(0))).items()), "mtld", *(c.alias(k) for k, c in m.paragraph_metrics().items())).first()
        found = row.asDict() if row else {"words": 0}
        found["top_tokens"] = [{"token": r["token"], "count": r["n"]} for r in m.top_tokens(counts.drop("_system")).collect()]
    finally:
        counts.unpersist()
    return found


def rule_counts(texts: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """rule_id, profile_count: a row for each rule."""
    spark = texts.sparkSession
    found = audit(texts.select(text), rules, keys=(), text=text, positions=False).groupBy("rule_id").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(r.id,) for r in rules], "rule_id string")
    return every.join(found, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("profile_count"))


def make_profile(name: str, texts: DataFrame, rules: Sequence[Rule], order: str = "ord", text: str = "text", diversity: bool = True) -> Profile:
    found = statistics(texts, order, text, diversity)
    return Profile(name, found.pop("words"), found, m.token_counts(texts, (), text), rule_counts(texts, rules, text))


# Drafts against a profile.


def style_gap(drafts: DataFrame, profile: Profile, keys: Sequence[str] = ("doc_id",), text: str = "text", diversity: bool = True) -> DataFrame:
    """keys, words, draft_* and profile_* metrics, delta_*, opening_runs: a row for each draft. A text is cut into sentences once, for the counters and the runs."""
    rows = drafts.select(*keys, text).withColumn("_spans", sentences(F.col(text))).withColumn("opening_runs", opening_runs(F.col(text), F.col("_spans")))
    rows = rows.withColumn("_paragraphs", m.measured_spans(F.col("_spans"))).drop("_spans")
    rows = rows.withColumns(m.structure_columns(F.col("_paragraphs")) | {"words": token_count(F.col(text)).cast("long")}).drop("_paragraphs")
    rows = rows.withColumn("draft_mtld", m.mtld(F.col(text)) if diversity else F.lit(None).cast("double"))
    rows = rows.withColumn("syllables", m.text_syllables(F.col(text)))
    found = m.structure_metrics() | m.readability(F.col("words"), F.col("sentences"), F.col("syllables")) | m.paragraph_metrics()
    rows = rows.withColumns({f"draft_{k}": c for k, c in found.items()})
    known = {k: profile.statistics.get(k) for k in [*assess.GAP_METRICS, *assess.PARAGRAPH_METRICS]}
    rows = rows.withColumns({f"profile_{k}": F.lit(v).cast("double") for k, v in known.items()})
    rows = rows.withColumns({f"delta_{k}": F.col(f"draft_{k}") - F.col(f"profile_{k}") for k in assess.GAP_METRICS})
    return rows.select(*keys, "words", *(f"{side}_{k}" for k in known for side in ("draft", "profile")), *(f"delta_{k}" for k in assess.GAP_METRICS), "opening_runs")


def gap_rows(gaps: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, metric, draft, profile, delta: a row for each draft and metric of style_gap."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), *(F.col(f"{side}_{k}").cast("double").alias(side) for side in ("draft", "profile", "delta"))) for k in assess.GAP_METRICS))
    return gaps.select(*keys, F.explode(rows).alias("g")).select(*keys, "g.*")


@dataclass(frozen=True)
class Assessment:
    """Tables of assessed drafts."""

    findings: DataFrame
    baseline: DataFrame
    gaps: DataFrame
    issues: DataFrame
    scores: DataFrame
    statistics: DataFrame


def assess_drafts(drafts: DataFrame, profile: Profile, rules: Sequence[Rule], keys: Sequence[str] = ("doc_id",), text: str = "text", diversity: bool = True) -> Assessment:
    """diversity: whether drafts' lexical diversity is computed; no issue or score uses it."""
    # Both are read several times below, and they hold all the work on texts.
    findings = written(audit(drafts, rules, keys=keys, text=text), "findings")
    gaps = written(style_gap(drafts, profile, keys, text, diversity), "gaps")
    counts = findings.groupBy(*keys, "rule_id").agg(F.count("*").alias("draft_count"))
    baseline = assess.rule_baseline(gaps, counts, profile.rules, profile.words, keys)
    scored = gaps.where((F.col("words") > 0) & F.col("draft_flesch_reading_ease").isNotNull())
    issues = assess.rule_issues(findings, baseline, keys).unionByName(assess.profile_issues(scored, keys)).join(scored.select(*keys), list(keys), "left_semi")
    issues = assess.assign(issues, keys)
    return Assessment(findings, baseline, gaps, issues, assess.scores(gaps, issues, keys), assess.statistics(gaps, keys))


def check_assessment(score: Mapping[str, Any], issues: Sequence[Mapping[str, Any]]) -> None:
    """Deductions of issues, of sections and of the total agree."""
    if score["status"] != "scored":
        return
    by_section = {s: sum(i["deduction"] for i in issues if i["section"] == s) for s in assess.SECTIONS}
    whole = assess.SECTION_MAXIMUM * len(assess.SECTIONS)
    if any(score[s] != assess.SECTION_MAXIMUM - n for s, n in by_section.items()) or score["total"] != whole - sum(by_section.values()):
        raise ValueError(f"an assessment's deductions do not add up: {score}")


def subsample_scores(texts: DataFrame, drafts: DataFrame, rules: Sequence[Rule], sizes: Sequence[int], trials: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """size, trial, draft, total: scores of every draft against profiles of ``sizes`` texts drawn without replacement.

    Texts are measured once; a profile is a sum of counters, so the draws move rows of numbers. There are as many profiles as sizes and trials.
    """
    counters = m.document_structure(texts.select(id, text), text).withColumn("syllables", m.text_syllables(F.col(text))).drop(text)
    counters = written(counters, "counters")
    drawn = written(subsamples(counters, sizes, trials, id), "drawn")
    sums = drawn.groupBy("size", "trial").agg(*(F.sum(c).alias(c) for c in (*m.COUNTERS, "syllables")))
    found = m.structure_metrics() | m.readability(F.col("words"), F.col("sentences"), F.col("syllables")) | m.paragraph_metrics()
    known = [k for k in [*assess.GAP_METRICS, *assess.PARAGRAPH_METRICS] if k != "mtld"]
    profiles = sums.select("size", "trial", F.col("words").alias("profile_words"), *(found[k].alias(f"profile_{k}") for k in known), F.lit(None).cast("double").alias("profile_mtld"))
    by_text = audit(texts, rules, keys=(id,), text=text, positions=False).groupBy(id, "rule_id").agg(F.count("*").alias("n"))
    counts = drawn.select("size", "trial", id).join(by_text, id).groupBy("size", "trial", "rule_id").agg(F.sum("n").alias("profile_count"))
    empty = Profile("", 0, {}, None, None)
    draft = style_gap(drafts, empty, (id,), text, diversity=False)
    draft = draft.select(id, "words", *(c for c in draft.columns if c.startswith("draft_")), "opening_runs")
    keys = ("size", "trial", id)
    gaps = written(draft.crossJoin(F.broadcast(profiles)), "gaps")  # a row for each size and trial
    places = assess.finding_places(audit(drafts, rules, keys=(id,), text=text), (id,))
    both = places.join(gaps.select(*keys, "words", "profile_words"), id).join(F.broadcast(counts), ["size", "trial", "rule_id"], "left").na.fill(0, ["profile_count"])
    excess = F.col("n") - assess.allowance(F.col("profile_count"), F.col("words"), F.col("profile_words"))
    issues = assess.excess_issues(both.withColumn("excess", excess).where("excess > 0"), keys).unionByName(assess.profile_issues(gaps, keys))
    scored = assess.scores(gaps, assess.assign(issues, keys), keys)
    return scored.select("size", "trial", F.col(id).alias("draft"), "total")


# Profiles on disk: the texts, a summary and two caches with what they were made from.


def build_profile(spark: SparkSession, name: str, paths: Sequence[str], root: str, rules: Sequence[Rule]) -> dict:
    texts = clean_texts(read_texts(spark, paths)).where(token_count(F.col("text")) > 0)
    stem = slug(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""))
    texts = texts.select(F.concat(stem, F.lit("-"), F.left(F.sha2("path", 256), F.lit(8))).alias("id"), F.col("path").alias("ord"), "text").persist()
    try:
        if texts.limit(1).count() == 0:
            raise InputError(f"no texts with words under {', '.join(paths)}")
        folder = Path(root) / name
        write_records(texts, str(folder / "references.jsonl"))
        found = statistics(texts)
        summary = {"name": name, "created": datetime.now(UTC).isoformat(timespec="seconds"), "metrics_version": METRICS_VERSION, "sources": sorted(r["ord"] for r in texts.select("ord").toLocalIterator()), "total_words": found.pop("words"), "statistics": found}
        write_json(str(folder / "profile.json"), summary)
    finally:
        texts.unpersist()
    write_caches(spark, name, root, rules)
    return summary


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _references(spark: SparkSession, folder: Path) -> DataFrame:
    return read_records(spark, str(folder / "references.jsonl"), allow_empty_text=True, allow_empty_file=True, what="references")


def write_caches(spark: SparkSession, name: str, root: str, rules: Sequence[Rule]) -> None:
    """Token counts by corpus, rule counts by corpus and rules; caches of other rules are dropped."""
    folder = Path(root) / name
    texts, corpus, mark = _references(spark, folder), _digest(folder / "references.jsonl"), fingerprint(rules)
    cache = folder / "cache"
    m.token_counts(texts).write.mode("overwrite").parquet(str(cache / "tokens"))
    write_json(str(cache / "tokens.json"), {"corpus": corpus, "metrics_version": METRICS_VERSION})
    counts = {r["rule_id"]: r["profile_count"] for r in rule_counts(texts, rules).collect()}  # as many as there are rules
    write_json(str(cache / f"rules-{mark[:16]}.json"), {"corpus": corpus, "rules": mark, "metrics_version": METRICS_VERSION, "counts": counts})
    for other in cache.glob("rules-*.json"):
        if other.name != f"rules-{mark[:16]}.json":
            other.unlink()


def _cached(path: Path, **wanted) -> dict | None:
    """A cache entry if it was made from the same things; anything else counts as absent."""
    try:
        entry = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return entry if isinstance(entry, dict) and all(entry.get(k) == v for k, v in wanted.items()) else None


def load_profile(spark: SparkSession, name: str, root: str, rules: Sequence[Rule]) -> Profile:
    """A profile with its counts, from the caches where they fit, else from the texts. Nothing is written."""
    folder = Path(root) / name
    if not (folder / "profile.json").is_file():
        raise InputError(f"no profile {name!r} under {root}")
    summary = read_json(str(folder / "profile.json"))
    if not isinstance(summary, dict) or not isinstance(summary.get("statistics"), dict):
        raise InputError(f"profile {name!r} is damaged; build it again")
    if summary.get("metrics_version") != METRICS_VERSION:
        raise InputError(f"profile {name!r} was built by another version of the metrics; build it again")
    corpus, mark = _digest(folder / "references.jsonl"), fingerprint(rules)
    texts = _references(spark, folder)
    cache = folder / "cache"
    hit = _cached(cache / "tokens.json", corpus=corpus, metrics_version=METRICS_VERSION) and (cache / "tokens" / "_SUCCESS").is_file()
    tokens = spark.read.schema("token string, n bigint").parquet(str(cache / "tokens")) if hit else m.token_counts(texts)
    entry = _cached(cache / f"rules-{mark[:16]}.json", corpus=corpus, rules=mark, metrics_version=METRICS_VERSION)
    counts = entry.get("counts") if entry else None
    if not isinstance(counts, dict) or set(counts) != {r.id for r in rules} or not all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in counts.values()):
        counted = rule_counts(texts, rules)
    else:
        counted = spark.createDataFrame(sorted(counts.items()), "rule_id string, profile_count bigint")
    words = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Profile(name, words, summary["statistics"], tokens, counted)


def list_profiles(root: str, on_skip=lambda name, why: None) -> list[dict]:
    """name, sources, total_words of the profiles under a folder; those that cannot be read are reported and left out."""
    out = []
    for path in sorted(Path(root).glob("*/profile.json")):
        try:
            summary = read_json(str(path))
            out.append({"name": summary["name"], "sources": len(summary["sources"]), "total_words": int(summary["total_words"])})
        except (InputError, KeyError, TypeError, ValueError) as error:
            on_skip(path.parent.name, str(error))
    return out
