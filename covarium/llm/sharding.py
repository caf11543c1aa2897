"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records over buckets of bounded size by a seeded hash.
Pass two holds a bucket in memory, orders it, permutes it by Spark's ``shuffle``
(Fisher-Yates with a seeded generator) and deals its records to the shards in
turn: bucket offsets make the positions one gapless sequence, position p goes to
shard ``p mod shards`` at slot ``p div shards``, so shards differ by one row at
most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm.common import fresh, materialise, text_or_empty

SHARDS, SEED, BUCKET_BYTES = 24, 7, 16 << 20
#: Buckets whose offsets are summed together.
GROUP = 4096


def _scattered(docs: DataFrame, size: Column, seed: int, buckets: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``h, size, record, bucket``: every row in a bucket by a hash of all its columns; and each bucket's rows ``n``.

    Rows alike in all columns would meet in one bucket. Where they overfill it,
    they are counted, map-side first, and each copy is hashed with its number.
    """
    plain = [c for c, t in docs.dtypes if "map<" not in t]
    rows = docs.select(F.xxhash64(F.lit(seed), *plain).alias("h"), F.xxhash64(F.lit(~seed), *plain).alias("check"), size.alias("size"), F.struct(*docs.columns).alias("record"))
    bucket = F.pmod("h", F.lit(buckets)).cast("int")

    def placed(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        scattered = some.select("h", "size", "record", bucket.alias("bucket"))
        counts, _ = materialise(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
        return scattered, counts

    scattered, counts = placed(rows)
    if counts.where(F.col("bytes") > 2 * bucket_bytes).isEmpty():
        return scattered, counts
    alike = rows.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes))
    alike = F.broadcast(alike.select("h", "check"))  # each is over a bucket of the input, so they are fewer than the buckets
    few = rows.join(alike, ["h", "check"], "left_semi").groupBy("h", "check").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("record").alias("record"))
    copies = few.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select(F.xxhash64("h", "copy").alias("h"), "size", "record")
    return placed(rows.join(alike, ["h", "check"], "left_anti").select("h", "size", "record").unionByName(copies))


def _offsets(counts: DataFrame) -> DataFrame:
    """``bucket, offset``: the rows of all buckets before; summed in groups of buckets, so that no task sees more than a group."""
    grouped = counts.select("bucket", "n").withColumn("group", F.expr(f"bucket div {GROUP}"))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("rows"))
    starts = groups.select("group", (F.sum("rows").over(Window.orderBy("group")) - F.col("rows")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    return grouped.withColumn("within", within).join(starts, "group").select("bucket", (F.col("start") + F.col("within")).alias("offset"))


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffle all rows and deal them to ``shards`` shards by the law ``rows``.

    Returns ``record`` (a struct of all columns of ``docs``, so no name can
    clash), ``size`` (UTF-8 bytes of the text plus 8), ``shard`` (int) and
    ``slot`` (long, gapless from 0 in its shard). Null texts count no bytes and
    stay null. Rows alike in some columns are scattered by the others; rows alike
    in all are scattered by their number where they are more than a bucket. A text
    larger than a bucket is one by itself. An empty table gives an empty one. The
    outcome is settled by the rows and the seed, so a task that runs again after a
    loss deals its rows as before. A bucket is a task's partition, whose number
    grows with the input.
    """
    size = F.octet_length(text_or_empty()).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered, counts = _scattered(docs, size, seed, buckets, bucket_bytes)
    offsets = _offsets(counts)
    order = F.struct(F.col("h"), F.col("size"), F.xxhash64("record").alias("again"), F.col("record"))
    permuted = (
        scattered.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(order).alias("rows"))
        .select("bucket", F.shuffle(F.array_sort("rows"), seed).alias("rows"))
    )
    return (
        permuted.join(offsets, "bucket")
        .select("offset", F.posexplode("rows").alias("pos", "row"))
        .select("row.record", "row.size", F.expr(f"cast((offset + pos) % {shards} as int)").alias("shard"), F.expr(f"(offset + pos) div {shards}").alias("slot"))
    )


def write_shards(shuffled: DataFrame, path: str, mode: str = "error") -> None:
    """Write what ``external_shuffle`` returns, one folder for each shard, its files and rows in slot order.

    Nulls are written as they are and repeated rows each; a shard without rows has
    no folder. Columns of the records named like ours keep their names.
    """
    n = int(shuffled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = shuffled.select("record.*", *(F.col(c).alias(fresh(shuffled.select("record.*"), c)) for c in ("shard", "slot")))
    shard, slot = named.columns[-2:]
    named.repartitionByRange(n, shard, slot).sortWithinPartitions(shard, slot).write.mode(mode).partitionBy(shard).parquet(path)
