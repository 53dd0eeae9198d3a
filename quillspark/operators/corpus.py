"""Corpora: sample ids, prompts, stratified splits, subsampling studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import sample_id, strip, strip_frontmatter, token_count

USE_CASES = ("article_section", "product_writing", "exec_communication")

# Prompt templates by use case.
PROMPTS = {
    "article_section": "Write an article section titled '%s'. Target length about %d words. Plain prose paragraphs, no headings unless the content demands one.",
    "product_writing": "Write product copy titled '%s'. Target length about %d words. Concrete benefits, no hype adjectives.",
    "exec_communication": "Write a concise executive communication titled '%s'. Target length about %d words. Lead with the decision or ask.",
}
# Fixed value: the instruction of a revision prompt.
REVISION = "Revise the following text to eliminate the listed style violations. Change only the offending spans; preserve meaning, length, and voice. Return only the revised text."


def samples(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """id, source_path, text (without frontmatter and outer white space), word_count and the other columns; empty texts raise."""
    body = strip(strip_frontmatter(F.col(text)))
    body = F.when(body == "", F.raise_error(F.concat(F.lit("sample text is empty: "), F.col(path))).cast("string")).otherwise(body)
    rest = [c for c in files.columns if c not in (path, text)]
    return files.select(sample_id(F.col(path)).alias("id"), F.col(path).alias("source_path"), body.alias("text"), *rest).withColumn("word_count", token_count(F.col("text")))


def split_holdout(rows: DataFrame, *, id: str = "id", stratum: str = "use_case", forced: str | None = None, fraction: float = 0.4, seed: int = 20260717) -> DataFrame:
    """Adds part: eval or holdout.

    Of each stratum, the rows first in the order of md5(id:seed) are eval: a share of ``fraction``,
    rounded to even, one row at least and one less than all of two rows or more. Rows marked
    ``forced`` are holdout and are not counted. The same seed gives the same split on any cluster.
    """
    forced_ = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    key = F.md5(F.concat(F.col(id).cast("string"), F.lit(f":{seed}")))
    rows = rows.withColumn("_forced", forced_)
    size = rows.where(~F.col("_forced")).groupBy(stratum).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(stratum, "_forced").orderBy(key, id))
    n = F.col("_n")
    take = F.greatest(F.bround(n * F.lit(fraction)), F.lit(1))
    take = F.least(F.when(n >= 2, F.least(take, n - 1)).otherwise(take), n)
    out = rows.withColumn("_place", place).join(size, stratum, "left")
    return out.withColumn("part", F.when(~F.col("_forced") & (F.col("_place") <= take), "eval").otherwise("holdout")).drop("_forced", "_place", "_n")


def build_prompt(use_case: Column, title: Column, words: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown use_case: "), use_case)).cast("string")
    for name, template in PROMPTS.items():
        out = F.when(use_case == name, F.format_string(template, title, words)).otherwise(out)
    return out


def revision_prompt(system: Column, findings: Column, text: Column) -> Column:
    """findings: array of struct(rule_id, message, matched_text), in order."""
    lines = F.transform(findings, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". ["), f["rule_id"], F.lit("] "), f["message"], F.lit(' (matched: "'), f["matched_text"], F.lit('")')))
    return F.concat(system, F.lit(f"\n\n{REVISION}\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"), text)


def generation_prompt(system: Column, task: Column) -> Column:
    return F.concat(system, F.lit("\n\n"), task)


def _drawn(rows: DataFrame, trials: int, id: str, seed: int, share: float) -> DataFrame:
    """Rows of each trial with their place in its order, _order; those first in it, about ``share`` of all."""
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    drawn = drawn.withColumn("_order", F.md5(F.concat_ws(":", F.col(id).cast("string"), F.col("trial"), F.lit(seed))))
    return drawn.where(F.col("_order") < f"{int(share * 16**8):08x}") if share < 1 else drawn


def subsamples(rows: DataFrame, sizes: Sequence[int], trials: int, id: str = "id", seed: int = 7) -> DataFrame:
    """size, trial and the rows of each trial's draw without replacement: the first of each trial's own order.

    Rows whose hash shows that they are not among the first are dropped before they are ranked, so a trial never ranks the whole table.
    """
    n, most = rows.count(), max(sizes)
    drawn = _drawn(rows, trials, id, seed, (2 * most + 64) / max(n, 1))
    if n > 2 * most + 64 and drawn.groupBy("trial").count().where(F.col("count") >= most).count() < trials:
        drawn = _drawn(rows, trials, id, seed, 1)  # too few by chance: rank all
    place = F.row_number().over(Window.partitionBy("trial").orderBy("_order", id))
    drawn = drawn.withColumn("_place", place).where(F.col("_place") <= most)
    return drawn.withColumn("size", F.explode(F.filter(F.array(*(F.lit(s) for s in sizes)), lambda s: s >= F.col("_place")))).drop("_place", "_order")


def budget_subsamples(rows: DataFrame, budgets: Sequence[int], trials: int, words: str = "words", id: str = "id", seed: int = 7) -> DataFrame:
    """size (the budget), trial and rows: each trial's own order is followed until the budget of words is reached."""
    total, most = rows.agg(F.sum(words)).first()[0] or 0, max(budgets)
    drawn = _drawn(rows, trials, id, seed, 2 * most / max(total, 1))
    if total > 2 * most and drawn.groupBy("trial").agg(F.sum(words).alias("w")).where(F.col("w") >= most).count() < trials:
        drawn = _drawn(rows, trials, id, seed, 1)
    order = Window.partitionBy("trial").orderBy("_order", id)
    before = F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("_before", before).where(F.col("_before") < most)
    return drawn.withColumn("size", F.explode(F.filter(F.array(*(F.lit(b) for b in budgets)), lambda b: b > F.col("_before")))).drop("_before", "_order")


def length_bands(rows: DataFrame, bands: int = 3, words: str = "words") -> DataFrame:
    """Adds band (from 1, the shortest first): equal shares of the rows by length, from its exact quantiles."""
    cuts = rows.agg(F.percentile(words, F.array(*(F.lit(k / bands) for k in range(1, bands)))).alias("c")).first()["c"] or []
    return rows.withColumn("band", sum((F.when(F.col(words) > c, 1).otherwise(0) for c in cuts), F.lit(1)))


def score_noise(scores: DataFrame, limit: float = 2.0) -> DataFrame:
    """size, mean_sd, median_sd, worst_sd, mean_range, mean_trimmed_range, coverage: spread of drafts' scores over trials. scores: size, trial, draft, total.

    The trimmed range leaves out a twentieth of a draft's scores on either side, by their places: from floor(0.05 n) to floor(0.95 n) - 1, from 0.
    """
    by_draft = scores.where("total is not null").groupBy("size", "draft").agg(F.stddev_samp("total").alias("sd"), (F.max("total") - F.min("total")).alias("range"), F.sort_array(F.collect_list("total")).alias("_all"))  # a score for each trial
    place = lambda share: F.floor(F.lit(share) * F.size("_all")).cast("int")
    by_draft = by_draft.withColumn("trimmed_range", F.get("_all", place(0.95) - 1) - F.get("_all", place(0.05)))
    return by_draft.groupBy("size").agg(F.avg("sd").alias("mean_sd"), F.median("sd").alias("median_sd"), F.max("sd").alias("worst_sd"), F.avg("range").alias("mean_range"), F.avg("trimmed_range").alias("mean_trimmed_range"), (F.count_if(F.col("sd") <= limit) / F.count("*")).alias("coverage"))
