"""Scores of drafts against a profile: allowances, issues, section caps, totals. Any number of drafts at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rubric.
SECTIONS = ["clarity_directness", "readability", "rhythm_structure", "vocabulary_style"]
SECTION_MAXIMUM = 25
CLARITY_RULES = ["negative_parallelism", "metadiscourse_openers", "vague_authority", "passive_voice", "hedging", "throat_clearing", "superficial_analysis", "negative_listing"]
DEDUCTION = {"warn": 2, "info": 0}
PRIORITIES = ["high", "medium", "low"]
GAP_METRICS = ["mean_sentence_length", "sentence_length_variance", "repeated_opening_rate", "flesch_reading_ease", "flesch_kincaid_grade", "mtld"]
PARAGRAPH_METRICS = ["paragraph_count", "mean_paragraph_sentence_count", "single_sentence_paragraph_rate"]
#: metric: (gap, tolerance)
TOLERANCE = {"mean_sentence_length": ("relative", 0.15), "sentence_length_variance": ("relative", 0.25), "repeated_opening_rate": ("absolute", 0.03), "flesch_reading_ease": ("absolute", 5.0), "flesch_kincaid_grade": ("absolute", 1.0), "mean_paragraph_sentence_count": ("relative", 0.15), "single_sentence_paragraph_rate": ("absolute", 0.05)}
WORDING = {"mean_sentence_length": ("longer", "shorter"), "sentence_length_variance": ("more varied", "more uniform"), "repeated_opening_rate": ("higher", "lower"), "flesch_reading_ease": ("easier", "harder"), "flesch_kincaid_grade": ("higher", "lower"), "mtld": ("higher", "lower"), "mean_paragraph_sentence_count": ("more", "fewer"), "single_sentence_paragraph_rate": ("higher", "lower")}


def scaled_deduction(gap: Column, tolerance: float, cap: float, most: float) -> Column:
    """0 up to the tolerance (or without a gap), then in proportion, ``most`` from the cap on."""
    if tolerance >= cap:
        raise ValueError("the tolerance must be below the cap")
    return F.when(gap.isNull() | (gap <= tolerance), 0.0).otherwise(F.lit(float(most)) * (F.least(gap, F.lit(float(cap))) - F.lit(tolerance)) / F.lit(cap - tolerance))


def absolute_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def relative_gap(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def gap_of(metric: str, a: Column, b: Column) -> Column:
    return (relative_gap if TOLERANCE[metric][0] == "relative" else absolute_gap)(a, b)


def direction(metric: str, draft: Column, target: Column) -> Column:
    """Which way a draft should move: maintain, increase, decrease, unavailable; informational for diversity."""
    if metric == "mtld":
        return F.lit("informational")
    move = F.when(draft < target, "increase").when(draft > target, "decrease").otherwise("maintain")
    return F.when(draft.isNull() | target.isNull(), "unavailable").when(gap_of(metric, draft, target) <= TOLERANCE[metric][1], "maintain").otherwise(move)


def interpretation(metric: str, value: Column, target: Column) -> Column:
    none = F.when(value.isNull(), "unavailable").when(target.isNull() if metric in WORDING else F.lit(True), "informational")
    if metric not in WORDING:
        return none
    more, less = (f"{w} than target" for w in WORDING[metric])
    if metric == "mtld":
        return none.when(value == target, "aligned; informational").when(value > target, f"{more}; informational").otherwise(f"{less}; informational")
    return none.when(gap_of(metric, value, target) <= TOLERANCE[metric][1], "closely aligned").when(value > target, more).otherwise(less)


def priority(deduction: Column) -> Column:
    return F.when(deduction >= 6, "high").when(deduction >= 3, "medium").otherwise("low")


def score_label(total: Column) -> Column:
    return F.when(total >= 90, "High alignment").when(total >= 75, "Moderate alignment").when(total >= 60, "Low alignment").otherwise("Very low alignment")


def allowance(profile_count: Column, draft_words: Column, profile_words: Column) -> Column:
    """profile_count * draft_words / profile_words, rounded up in whole numbers."""
    a, b, c = (x.cast("decimal(19,0)") for x in (profile_count, draft_words, profile_words))
    top = a * b + c - 1
    return ((top - F.pmod(top, c)) / c).cast("bigint")


def rule_baseline(drafts: DataFrame, draft_counts: DataFrame, profile_counts: DataFrame, profile_words: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, rule_id, profile_count, profile_rate_per_1000, draft_count, allowance, excess.

    drafts: keys, words. draft_counts: keys, rule_id, draft_count. profile_counts: rule_id, profile_count; a row for each rule.
    """
    if profile_words <= 0:
        raise ValueError("the profile has no words")
    words = drafts.select(*keys, "words")
    known = words.crossJoin(F.broadcast(profile_counts.select("rule_id", "profile_count")))  # rules are few and bounded by the rule file
    both = known.join(draft_counts, [*keys, "rule_id"], "full_outer").drop("words").join(words, list(keys))
    both = both.na.fill(0, ["profile_count", "draft_count"])
    out = both.withColumn("profile_rate_per_1000", F.col("profile_count") * F.lit(1000.0) / F.lit(profile_words))
    out = out.withColumn("allowance", allowance(F.col("profile_count"), F.col("words"), F.lit(profile_words)))
    return out.withColumn("excess", F.greatest(F.lit(0), F.col("draft_count") - F.col("allowance"))).drop("words")


ISSUE = ("issue_id", "kind", "section", "priority", "requested", "by_profile", "line", "column")


def finding_places(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, rule_id, n, severity, at: how often each rule was found, and the first place. Repeated openings are scored by their rate."""
    return findings.where("rule_id <> 'repeated_openings'").groupBy(*keys, "rule_id").agg(F.count("*").alias("n"), F.min_by("severity", F.struct("line", "column", "matched_text")).alias("severity"), F.min(F.struct("line", "column")).alias("at"))


def rule_issues(findings: DataFrame, baseline: DataFrame | None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rules whose findings exceed their allowance (all of them, without a baseline)."""
    found = finding_places(findings, keys)
    if baseline is not None:
        found = found.join(baseline.select(*keys, "rule_id", "excess"), [*keys, "rule_id"], "left").withColumn("excess", F.when(F.col("excess").isNull(), F.col("n")).otherwise(F.col("excess"))).where("excess > 0")
    else:
        found = found.withColumn("excess", F.col("n"))
    return excess_issues(found, keys)


def excess_issues(found: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """found: keys, rule_id, severity, at, excess (above 0)."""
    points = F.when(F.col("severity") == "warn", DEDUCTION["warn"]).otherwise(DEDUCTION["info"])
    return found.select(
        *keys, F.col("rule_id").alias("issue_id"), F.when(F.col("severity") == "info", "review_candidate").otherwise("improvement").alias("kind"),
        F.when(F.col("rule_id").isin(*CLARITY_RULES), "clarity_directness").otherwise("vocabulary_style").alias("section"),
        F.when(F.col("severity") == "warn", "medium").otherwise("low").alias("priority"), (points * F.col("excess")).cast("int").alias("requested"), F.lit(False).alias("by_profile"), F.col("at.line").alias("line"), F.col("at.column").alias("column"),
    )


def profile_issues(gaps: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Issues of metrics that differ from the profile's. gaps: keys, draft_* and profile_* of GAP_METRICS, opening_runs (array of line, column)."""
    d = {m: F.col(f"draft_{m}") for m in GAP_METRICS}
    p = {m: F.col(f"profile_{m}") for m in GAP_METRICS}
    gap = {m: gap_of(m, d[m], p[m]) for m in GAP_METRICS if m in TOLERANCE}
    raw = {
        "readability_alignment": ("readability", scaled_deduction(gap["flesch_reading_ease"], 5.0, 30.0, 6.0) + scaled_deduction(gap["flesch_kincaid_grade"], 1.0, 4.0, 6.0)),
        "sentence_rhythm": ("rhythm_structure", scaled_deduction(gap["mean_sentence_length"], 0.15, 1.0, 8.0) + scaled_deduction(gap["sentence_length_variance"], 0.25, 1.0, 7.0)),
        "repeated_openings": ("rhythm_structure", scaled_deduction(gap["repeated_opening_rate"], 0.03, 0.20, 10.0)),
    }
    first = F.get(F.sort_array("opening_runs"), F.lit(0))
    issues = []
    for name, (section, points) in raw.items():
        own = name == "repeated_openings"
        review = (points <= 0) & (F.size("opening_runs") > 0) if own else F.lit(False)
        value = F.struct(
            F.lit(name).alias("issue_id"), F.when(review, "review_candidate").otherwise("improvement").alias("kind"), F.lit(section).alias("section"), F.when(review, "low").otherwise(priority(round_half_up(points))).alias("priority"),
            round_half_up(points).alias("requested"), (~review).alias("by_profile"), (first["line"] if own else F.lit(None).cast("int")).alias("line"), (first["column"] if own else F.lit(None).cast("int")).alias("column"),
        )
        issues.append(F.when((points > 0) | review, value))
    return gaps.select(*keys, F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("i")).select(*keys, "i.*")


def _rank(column: str, values: Sequence[str]) -> Column:
    out = F.lit(len(values))
    for n, v in enumerate(values):
        out = F.when(F.col(column) == v, n).otherwise(out)
    return out


def assign(issues: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Deductions in the issues' order, until a section's maximum is used up; profile issues get their priority from it."""
    order = [_rank("priority", PRIORITIES), _rank("section", SECTIONS), F.col("issue_id"), F.col("line").asc_nulls_last(), F.col("column").asc_nulls_last()]
    before = Window.partitionBy(*keys, "section").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = issues.withColumn("used", F.coalesce(F.sum("requested").over(before), F.lit(0)))
    out = out.withColumn("deduction", F.greatest(F.lit(0), F.least(F.col("requested"), F.lit(SECTION_MAXIMUM) - F.col("used"))).cast("int")).drop("used")
    out = out.withColumn("priority", F.when(F.col("by_profile"), priority(F.col("deduction"))).otherwise(F.col("priority")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def scores(drafts: DataFrame, assigned: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, status, total, label and a score for each section. drafts: keys, words, draft_flesch_reading_ease. Drafts without words or sentences are unscored."""
    lost = assigned.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("section") == s, F.col("deduction"))), F.lit(0)).alias(s) for s in SECTIONS))
    ok = (F.col("words") > 0) & F.col("draft_flesch_reading_ease").isNotNull()
    out = drafts.select(*keys, ok.alias("ok")).join(lost, list(keys), "left").withColumns({s: F.when(F.col("ok"), F.lit(SECTION_MAXIMUM) - F.coalesce(s, F.lit(0))).cast("int") for s in SECTIONS})
    total = sum((F.col(s) for s in SECTIONS[1:]), F.col(SECTIONS[0]))
    return out.select(*keys, F.when(F.col("ok"), "scored").otherwise("unscored").alias("status"), total.cast("int").alias("total"), F.when(F.col("ok"), score_label(total)).alias("label"), *SECTIONS)


def statistics(gaps: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Ten rows for each draft: statistic, value, target, interpretation."""
    rows = [F.struct(F.lit("word_count").alias("statistic"), F.col("words").cast("double").alias("value"), F.lit(None).cast("double").alias("target"), F.lit("informational").alias("interpretation"))]
    for m in [*GAP_METRICS, *PARAGRAPH_METRICS]:
        value = F.col(f"draft_{m}").cast("double")
        target = F.lit(None).cast("double") if m == "paragraph_count" else F.col(f"profile_{m}").cast("double")
        rows.append(F.struct(F.lit(m).alias("statistic"), value.alias("value"), target.alias("target"), interpretation(m, value, target).alias("interpretation")))
    return gaps.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*")
