"""Distributed connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Native DataFrame code. A hub's neighbourhood is never gathered in one place: the
minimum is a partially aggregated ``groupBy`` and comes back by a join to which
the hubs' rows don't move: the few vertices that hold much of all edges are
broadcast. Each round is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import discard, join_counted, materialise


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every vertex that has an edge with the smallest vertex it can reach.

    ``edges`` has two columns of any one orderable type, in any direction, with
    repeats and loops allowed; rows with a null end are ignored. Returns
    ``(vertex, component)``, one row per vertex of an edge between two different
    vertices; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    now, path = materialise(start.distinct())
    before = _digest(now)
    for _ in range(max_rounds):
        total = 2 * before[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both.where("v > u"), low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            join_counted(large, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        ).distinct()
        after, new_path = materialise(small)
        discard(spark, [path])
        now, path = after, new_path
        if (digest := _digest(now)) == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
