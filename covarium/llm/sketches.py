"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct hashes of a text's shingles. Sketches of parts
merge into that of the whole; two of them estimate resemblance, containment and
the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm.common import text_or_empty
from covarium.llm.simhash import shingle_hashes

K, WIDTH, SEED = 128, 5, 42


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, in order."""
    if len(hashes) > 16 * k:  # distinct values among the smallest are all that matter
        part = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def sketch(text: str, k: int = K, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    return bottom_k(shingle_hashes(text.encode(), width, seed), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's sketch that is in both. Two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k)) if len(a) else 1.0


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def _sketched(k: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [sketch(t.as_py(), k, width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_text, sketches), pa.string()), pa.array((distinct(s, k) for s in sketches), pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return run


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint, n_shingles)`` of every row: the sketch in hex and the estimated distinct shingles.

    Null and blank texts have the empty fingerprint. Repeated rows and null
    doc_ids come back as they are; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_sketched(k, width, seed), "doc_id long, fingerprint string, n_shingles double")


def _edited(k: int, width: int, seed: int):
    """Rows come by range and descending doc_id; each is finished when its successor is known."""
    columns = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def finish(row, following):
        doc, text, mark = row
        n = len(text)
        edited = text[: n - n // 2] + following[1][: n // 2]
        other = sketch(edited, k, width, seed)
        return doc, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(mark), to_text(other), resemblance(mark, other, k), resemblance(mark, following[2], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, row)
        for batch in batches:
            out = []
            for part, doc, text, ghost in zip(*(batch.column(c) for c in range(4))):
                part, text = part.as_py(), text.as_py()
                row = (doc.as_py(), text, sketch(text, k, width, seed))
                if held and held[0] == part:
                    out.append(finish(held[1], row))
                held = None if ghost.as_py() else (part, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), columns)], [n for n, _ in columns])

    return run


def edit_likeness(docs: DataFrame, k: int = K, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Compare each text's fingerprint with that of its edited text and of the next document.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by as
    many of the start of the next document in descending doc_id (all, if it has
    fewer); the first follows the last. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next`` for every row. Null
    text counts as empty. Rows with one doc_id follow one another by a hash of
    their text and then by it; null doc_ids come last. A lone row follows itself;
    an empty table gives an empty one. Rows are ranged by doc_id, those of a
    doc_id that fills a range, or of none, by the hash as well, and each range is
    ended by a copy of the next one's first row, so no task sees more than a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 3 * n
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    # each has more than a range's share of all rows, so there are fewer than ranges; a double tells longs below 2^53
    crowds = {r["doc_id"]: -(-ranges * r["n"] // total) for r in counted.where(F.col("n") * ranges > total).collect()}
    alone = [i for i in crowds if i is not None and abs(i) < 1 << 53]
    cuts = rows.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if total else []
    bounds = sorted({*cuts, *map(float, alone), *(float(i + 1) for i in alone)})
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="id", outputCol="cut", handleInvalid="keep")
    # the bounds are the ranges' parameters, as many as there are partitions
    ranged = cut.transform(rows.withColumn("id", F.col("doc_id").cast("double"))) if bounds else rows.withColumn("cut", F.lit(0.0))
    pieces = F.coalesce(*(F.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(crowds[i])) for i in [*alone, *([None] if None in crowds else [])]), F.lit(1))
    dealt = (
        ranged.withColumn("h", F.xxhash64("text"))
        .withColumn("major", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - F.col("cut").cast("int")))
        .withColumn("minor", F.least(pieces - 1, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * pieces).cast("int")))
        .select((F.col("major").cast("long") * (1 << 32) + F.col("minor")).alias("part"), "doc_id", "h", "text")
    )
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("part")
    every = heads.select("part", "head", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("before"))
    ghosts = (
        dealt.join(F.broadcast(every), (dealt["part"] == every["part"]) & dealt["doc_id"].eqNullSafe(every["head"]))
        .select(every["before"].alias("part"), dealt["doc_id"], dealt["h"], dealt["text"])
        .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("h", "text")))
        .where("rank = 1").drop("rank")
    )
    together = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return (
        together.withColumn("task", F.pmod(F.expr("part div 4294967296") + F.expr("part % 4294967296"), F.lit(n)).cast("int"))
        .repartitionById(n, "task")  # ranges in turn, so that each task has as many
        .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
        .select("part", "doc_id", "text", "ghost")
        .mapInArrow(_edited(k, width, seed), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
