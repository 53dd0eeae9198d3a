"""Joins and running values that no single key or group can turn into one task's work. DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, found: DataFrame, keys: Sequence[str], total: int, times: str = "times") -> DataFrame:
    """Inner join of ``total`` rows with one row for each key, which says how many rows have the key.

    Keys of more than a thousandth of the rows, a thousand keys at most, are joined by broadcast; so no other task gets more rows of one key.
    """
    keys, hot = list(keys), F.col(times) > max(1, total // 1000)
    few = F.broadcast(found.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(found.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def latest(rows: DataFrame, keys: Sequence[str], at: str, mark: Column, name: str, block: int) -> DataFrame:
    """Adds the largest ``at`` of the rows of the same keys that are marked and come before; null if there is none.

    rows: one for keys and ``at``, an integer. It is found within blocks of ``block`` values, then between blocks, so a key may hold any share of the rows.
    """
    by = [*keys, "_block"]
    rows = rows.withColumn("_block", F.floor(F.col(at) / F.lit(block)))
    here = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(mark, F.col(at))
    blocks = rows.groupBy(*by).agg(F.max(value).alias("_last")).withColumn("_before", F.max("_last").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("_inside", F.max(value).over(here)).join(blocks.drop("_last"), by).withColumn(name, F.coalesce("_inside", "_before")).drop("_block", "_inside", "_before")
