"""Connected components of an edge list by alternating large and small stars.

Each round joins every node with the least of its neighbourhood, so chains and
stars shrink to stars around their least node in a logarithmic number of rounds.
Only aggregates and joins run; nothing is collected, and a node with very many
neighbours is one side of a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.store import Tables

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, root (the least node that is reachable) for every node in ``edges`` (a, b: orderable, not null).

    The last round's table, which the result reads, stays in ``tables``.
    """
    tables = tables or Tables(edges.sparkSession)
    down_of = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = tables.add(down_of(edges))
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, tables.add(down_of(small.unionAll(down.select("a", F.col("m").alias("b")))))
        tables.drop(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
