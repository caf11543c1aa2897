"""Shared helpers: shared-storage materialisation, fresh column names, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of the corpus contracts, as a character class body.
SPACES = "\\x20\\x09-\\x0D"


#: A key with more than one in so many of all rows is joined by a broadcast, of so many keys at most.
HEAVY = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``, or in local mode, where it is unset, one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/covarium-checkpoints"
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application writes; ``discard_run`` drops it."""
    return f"{shared_dir(spark)}/covarium-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and keeps
    results of Python stages from being computed twice. Returns the frame and
    its path for ``discard``.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that ``materialise`` wrote and that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_run(spark: SparkSession) -> None:
    """Delete every table that this application has left in shared storage, once no frame it returned is read again."""
    discard(spark, [run_dir(spark)])


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key``, one column or several, with ``table``, which has one row for each key and in ``n`` about how many of ``rows`` have it.

    Keys of more than one in ``HEAVY`` of all ``total`` rows, at most ``HEAVY`` of
    them, are broadcast and their rows dealt out at random by the exchange, which
    so sends no more than that to one task. ``how`` is inner or left; ``n`` goes.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in table.columns if c not in keys and c != "n"]
    salt, hot, cold = (fresh(rows, c) for c in ("salt", "hot", "cold"))
    found = F.struct(*values)
    heavy = table.where(F.col("n") * HEAVY > total).select(*keys, found.alias(hot))
    rest = table.where(F.col("n") * HEAVY <= total).select(*keys, F.lit(0).alias(salt), found.alias(cold))
    dealt = F.when(F.col(hot).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(HEAVY)).cast("int"))
    both = rows.join(F.broadcast(heavy), keys, "left").withColumn(salt, dealt).join(rest, [*keys, salt], "left")
    if how == "inner":
        both = both.where(F.col(hot).isNotNull() | F.col(cold).isNotNull())
    return both.select(*rows.columns, *(F.coalesce(F.col(f"{hot}.{c}"), F.col(f"{cold}.{c}")).alias(c) for c in values))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def thinned(key: Column, total: int, wanted: int) -> Column:
    """True for about twice as many of ``total`` rows as are wanted, by a uniform hash ``key``; for all where there are fewer.

    A bounded sample is then ordered and cut from these alone, so that what meets
    on the driver doesn't grow with the partitions.
    """
    share = min(1.0, (2 * wanted + 100) / max(1, total))
    return F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)) + 1
