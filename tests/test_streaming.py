"""Windowed moments of a stream add up to the batch covariance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from covarium.streaming.covariances import covariance_of, windowed_moments


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    both = lambda df: df.select("ts", "user_id", "value", F.length("props").cast("double").alias("size"))
    stream = both(spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events*.parquet"))
    q = windowed_moments(stream, ["value", "size"], ["user_id"]).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    try:
        q.processAllAvailable()
        got = {r.user_id: r for r in covariance_of(spark.table("moments"), ["value", "size"], ["user_id"]).collect()}
    finally:
        q.stop()
    want = both(spark.read.parquet(path)).groupBy("user_id").agg(F.covar_pop("value", "size").alias("c"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.user_id].n == r.n and got[r.user_id].cov[0] == pytest.approx(r.v, abs=1e-6) and got[r.user_id].cov[1] == pytest.approx(r.c, abs=1e-6)
