"""Running covariance sums of a stream of samples by event-time window, mergeable and late-data bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), time: str = "ts", width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Counts, sums and products of ``columns`` for each key and tumbling window; works on streams and on batches.

    Rows with a null in any column are left out. On a stream, a window is final
    once the watermark has passed it.
    """
    whole = stream.dropna(subset=list(columns)).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    sums = [F.sum(c).alias(f"s_{c}") for c in columns]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return whole.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def covariance_of(moments: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, cov`` from moments summed over all their windows; the covariance in row-major order."""
    names = [*(f"s_{c}" for c in columns), *(f"p_{a}_{b}" for i, a in enumerate(columns) for b in columns[i:])]
    total = moments.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names))

    def cell(i: int, j: int):
        a, b = columns[min(i, j)], columns[max(i, j)]
        return F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"s_{a}") / F.col("n") * F.col(f"s_{b}") / F.col("n")

    d = len(columns)
    return total.select(*keys, "n", F.array(*(cell(i, j) for i in range(d) for j in range(d))).alias("cov"))
