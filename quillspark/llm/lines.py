"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

Lines are what "\\n" separates; blank ones (white space only) are left out of all counting and are kept.
A run is repeated if its lines stand somewhere before in the same order: ``window`` consecutive lines at least, or one line of at
least ``long_chars`` characters.

1. Grams of two lines are hashed. The smallest gram of each window of ``window`` lines is a fingerprint, so whoever shares a
   window shares its fingerprint. A long line is a fingerprint of its own; windows of long lines alone need no other.
2. Fingerprints found at one place only are dropped; places of the others are joined.
3. Each place is extended both ways, line by line, to the windows that hold it, which are compared by two independent
   hashes. Places are in the order of id (nulls last), row and line; windows that have an earlier place and follow each other
   make the repeated runs.
4. Every line of a repeated run is deleted. Its first place stays.

First places are minima, aggregated before the shuffle. Fingerprints and windows that hold more than a thousandth of all
places, a thousand of them at most, are joined by broadcast, so a line that very many documents share is no group in one task.

Cases: null texts and texts without lines keep what they are and count 0 lines. Of repeated rows,
the first keeps its lines. Texts that lose all their lines become blank or empty. An empty table
gives no rows. Other columns are carried if named in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import written
from quillspark.llm.joins import join_counted


def dedup_lines(docs: DataFrame, *, text: str = "text", id: str = "doc_id", keep: Sequence[str] = ("doc_id",), window: int = 3, long_chars: int = 60) -> DataFrame:
    """One row for each document row: row (struct of the kept columns), kept_text, lines, removed_lines."""
    # Columns go by number, so a text is written and shuffled once, kept or not.
    names = list(dict.fromkeys([*keep, id, text]))
    own = {c: f"c{k}" for k, c in enumerate(names)}
    t = F.col(own[text])
    rows = written(docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in names)).withColumn("rid", F.monotonically_increasing_id()), "lines")

    full = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("s"), (F.length(x) >= long_chars).alias("long")))
    lines = written(rows.select("rid", F.col(own[id]).alias("id"), line.alias("l")).selectExpr("rid", "id", "l.h as h", "l.s as s", "l.long as long"), "hashes")

    # explode_outer, as Spark guards explode with a filter that evaluates what is exploded a second time.
    gram = min(2, window)
    per = window - gram + 1  # grams of a window
    # Windows that are not made of long lines alone, and the place of each one's smallest gram.
    grams = lines.selectExpr("rid", "long", f"if(size(h) >= {window}, transform(sequence(1, size(h) - {gram - 1}), i -> xxhash64(slice(h, i, {gram}))), array()) as grams", "h")
    least = f"""array_distinct(transform(
        filter(sequence(1, size(grams) - {per - 1}), i -> exists(slice(long, i, {window}), x -> not x)),
        i -> i - 1 + cast(array_position(slice(grams, i, {per}), array_min(slice(grams, i, {per}))) as int)))"""
    marks = f"""concat(
        if(size(grams) >= {per}, transform({least}, i -> struct(grams[i - 1] as print, i as at, {gram} as n)), array()),
        if(size(h) > 0, transform(filter(sequence(1, size(h)), i -> long[i - 1]), i -> struct(h[i - 1] as print, i as at, 1 as n)), array()))"""
    prints = written(grams.select("rid", F.explode_outer(F.expr(marks)).alias("m")).where("m is not null").select("rid", "m.*"), "fingerprints")
    total = prints.count()
    shared = prints.groupBy("print", "n").agg(*(f(c).alias(f"{c}_{f.__name__}") for f in (F.min, F.max) for c in ("rid", "at")), F.count("*").alias("times"))
    shared = written(shared.where("rid_min <> rid_max or at_min <> at_max").select("print", "n", "times"), "shared")
    met = join_counted(prints, shared, ["print", "n"], total).groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("met"))

    around = f"""array_distinct(flatten(transform(filter(met, m -> m.n = {gram} and {window} > 1), m -> sequence(greatest(m.at - {per - 1}, 1), least(m.at, size(h) - {window - 1})))))"""
    extended = f"""concat(
        transform(filter({around}, i -> exists(slice(long, i, {window}), x -> not x)), i -> struct(i as start, {window} as n, xxhash64(slice(h, i, {window})) as a, xxhash64(slice(s, i, {window})) as b)),
        transform(filter(met, m -> m.n = 1), m -> struct(m.at as start, 1 as n, h[m.at - 1] as a, s[m.at - 1] as b)))"""
    windows = written(lines.join(met, "rid").select("rid", "id", F.explode_outer(F.expr(extended)).alias("w")).where("w is not null").select("rid", "id", "w.*"), "windows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid", "start")
    first = windows.groupBy("n", "a", "b").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = written(first.selectExpr("n", "a", "b", "times", "first.rid as first_rid", "first.start as first_start"), "first")
    later = join_counted(windows, first, ["n", "a", "b"], windows.count()).where("rid <> first_rid or start <> first_start")
    gone = later.groupBy("rid").agg(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))).alias("gone"))

    # Numbers of the lines that are not blank, of those that go, and of those that stay.
    number = F.filter(F.transform(F.split(t, "\n", -1), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    out = rows.join(gone, "rid", "left").withColumn("full", number)
    out = out.withColumn("gone", F.expr("if(gone is null, null, transform(array_distinct(gone), i -> full[i - 1]))"))
    out = out.withColumn("all", F.when(F.col("gone").isNotNull(), F.split(t, "\n", -1)))
    kept = F.array_join(F.expr("transform(array_except(sequence(0, size(all) - 1), gone), i -> all[i])"), "\n")
    return out.select(
        F.struct(*(F.col(own[c]).alias(c) for c in keep)).alias("row"),
        F.when(F.col("gone").isNull(), t).otherwise(kept).alias("kept_text"),
        F.coalesce(F.size("full"), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
    ).withColumns({c: F.greatest(c, F.lit(0)) for c in ("lines", "removed_lines")})
