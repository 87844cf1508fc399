"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a partial-aggregated minimum per node and a join back to the edges; tables of a round are written to the shared folder, so that no
round depends on the executors of an earlier one.  The rounds end when the edges no longer change, then every node points to the least node of
its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; ``edges`` has the bigint columns a and b.  Loops, nulls, repeated and reversed edges do no harm."""
    now = staged(edges.where("a != b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = staged(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
