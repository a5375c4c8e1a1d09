"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import cut, free


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star steps: every node's larger neighbours, then its smaller ones, are tied to
    its smallest neighbour, until the edges form stars; the number of rounds grows with the logarithm of the number
    of nodes. Minima are aggregated before they are joined, so a node of very high degree is one row on one side and
    rows that a skewed join may split on the other. Self-loops and repeated edges change nothing, null ends
    are no edges, and an edgeless graph gives no rows. Each round's edges replace those before it on disk; the result reads the last.
    """
    a = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    now = cut(a.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 0):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        free(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = tied.union(tied.select(F.col("component").alias("node"), "component").distinct())
    out._cut_path = now._cut_path
    return out


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)
