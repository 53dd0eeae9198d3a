"""Connected components of a graph given as a table of links, by alternating star operations.

Each step hangs a node's larger neighbours (large star) or smaller ones (small star) on its
smallest neighbour. Links, labels and components stay distributed tables; steps are written to
the shared folder. A hub's links are aggregated before they are shuffled.

Cases: links from a node to itself and repeated links are dropped. No links: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b, distinct."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, task_rows: int = 250_000) -> DataFrame:
    """node, root for every node with a link: root is the component's smallest node. Steps run in as many tasks as their rows need."""
    state = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    print_of = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == print_of or not now[0]:
            break
        print_of, tasks = now, 1 + now[0] // task_rows
        state = written(_star(written(_star(state, True).coalesce(tasks), "links"), False).coalesce(tasks), "links")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
