"""Literals that a revision must keep: quotes, URLs, dates and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.regex import SPACE, to_java
from quillspark.functions.text import casefold, matches, strip

# What counts as a literal, in order of precedence.
QUOTE = r'"[^"\n]+"|“[^”\n]+”'
URL = r"""(?i)https?://[^\s<>()\[\]{}"'“”]+"""
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*|\s+)\d{{4}})\b"
NUMBER = r"(?<!\w)[-+]?[$€£]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?!\w)"
URL_TAIL = r"[.,;:!?]+(?![\s\S])"


def _flat(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"[{SPACE}]+", " ")


def _kind(text: Column, kind: str, pattern: str) -> Column:
    """Matches as kind, value (normalised), start, end."""
    found = matches(text, to_java(pattern))
    if kind == "url":
        found = F.transform(found, lambda m: F.struct(F.regexp_replace(m["text"], URL_TAIL, "").alias("text"), m["start"].alias("start")))
    value = {
        "quote": lambda s: _flat(F.substring(s, F.lit(2), F.length(s) - 2)),
        "url": lambda s: s,
        "date": lambda s: casefold(_flat(F.replace(s, F.lit(","), F.lit(" ")))),
        "number": lambda s: F.replace(s, F.lit(","), F.lit("")),
    }[kind]
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), value(m["text"]).alias("value"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end")))


def literals(text: Column) -> Column:
    """Array of kind, value, start, end, by position: a kind's matches count where they overlap none of an earlier kind."""
    text = F.coalesce(text, F.lit(""))
    kept = _kind(text, "quote", QUOTE)
    for kind, pattern in (("url", URL), ("date", DATE), ("number", NUMBER)):
        before = kept
        kept = F.concat(before, F.filter(_kind(text, kind, pattern), lambda x, before=before: ~_overlaps(before, x)))
    return F.array_sort(kept, lambda a, b: _order(a, b))


def _overlaps(kept: Column, x: Column) -> Column:
    return F.exists(kept, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"]))


def _order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for field in ("value", "kind", "start"):
        out = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(out)
    return out


def literal_rows(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    # Column by column, so that each kind's matches are found once.
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_kept", _kind(F.col("_t"), "quote", QUOTE))
    for kind, pattern in (("url", URL), ("date", DATE), ("number", NUMBER)):
        rows = rows.withColumn("_new", _kind(F.col("_t"), kind, pattern)).withColumn("_kept", F.concat("_kept", F.filter("_new", lambda x: ~_overlaps(F.col("_kept"), x))))
    return rows.select(*keys, F.explode("_kept").alias("l")).select(*keys, "l.*")


def compare_literals(source: DataFrame, revised: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each record of either side: status, counts of literals, missing and added, and a reason where a side has no such record."""

    def counted(docs: DataFrame, name: str) -> DataFrame:
        return literal_rows(docs, (id,), text).groupBy(id, "kind", "value").agg(F.count("*").alias(name))

    both = counted(source, "s").join(counted(revised, "r"), [id, "kind", "value"], "full_outer").na.fill(0, ["s", "r"])
    item = lambda n: F.struct("kind", "value", n.alias("count"))
    lost, new = F.greatest(F.col("s") - F.col("r"), F.lit(0)), F.greatest(F.col("r") - F.col("s"), F.lit(0))
    sums = both.groupBy(id).agg(
        F.sum("s").alias("source_literal_count"), F.sum("r").alias("revised_literal_count"), F.sum(lost).alias("missing_count"), F.sum(new).alias("added_count"),
        F.sort_array(F.collect_list(F.when(lost > 0, item(lost)))).alias("missing"), F.sort_array(F.collect_list(F.when(new > 0, item(new)))).alias("added"),
    )
    sides = source.select(id, F.lit(True).alias("in_source")).join(revised.select(id, F.lit(True).alias("in_revised")), id, "full_outer")
    reason = F.when(F.col("in_source").isNull(), "record_missing_from_source").when(F.col("in_revised").isNull(), "record_missing_from_revision")
    out = sides.join(sums, id, "left").withColumn("reason", reason)
    counts = ("source_literal_count", "revised_literal_count", "missing_count", "added_count")
    for c in counts:
        out = out.withColumn(c, F.when(F.col("reason").isNull(), F.coalesce(c, F.lit(0))).otherwise(0))
    none = F.array().cast("array<struct<kind:string,value:string,count:bigint>>")
    for c in ("missing", "added"):
        out = out.withColumn(c, F.when(F.col("reason").isNull(), F.coalesce(c, none)).otherwise(none))
    status = F.when(F.col("reason").isNull() & (F.col("missing_count") == 0) & (F.col("added_count") == 0), "pass").otherwise("fail")
    return out.select(id, status.alias("status"), *counts, "missing", "added", "reason")


def literal_summary(records: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "fail")
    return records.agg(F.when(failed == 0, "pass").otherwise("fail").alias("status"), F.count("*").alias("record_count"), failed.alias("failed_record_count"), F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing_literal_count"), F.coalesce(F.sum("added_count"), F.lit(0)).alias("added_literal_count"))
