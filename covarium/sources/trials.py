"""Trial tables: the container's checks, a catalogue of loaders, a seeded generator, views over tables, a keyed Parquet cache."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
SCHEMA = "trial_id long, subject string, session string, label int, signal array<array<double>>"
#: Samples for each channel under which covariances are poorly conditioned.
MIN_RATIO = 2.0


@dataclass(frozen=True)
class Summary:
    n_trials: int
    n_channels: int
    n_times: int
    n_subjects: int
    n_classes: int
    chance_accuracy: float
    class_balance: dict
    trials_per_subject: dict

    def duration(self, rate: float) -> float:
        """Seconds of a trial at a sampling rate."""
        return self.n_times / rate

    @property
    def samples_per_channel(self) -> float:
        return self.n_times / self.n_channels

    def __str__(self) -> str:
        return f"{self.n_trials} trials of {self.n_channels} x {self.n_times}, {self.n_subjects} subjects, {self.n_classes} classes, chance {self.chance_accuracy:.3f}"


def validate(trials: DataFrame) -> dict:
    """Check a trial table in one aggregate: shapes alike, finite, two classes, more samples than channels."""
    flat = F.flatten("signal")
    r = trials.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("signal")).alias("c0"), F.max(F.size("signal")).alias("c1"),
        F.min(F.array_min(F.transform("signal", F.size))).alias("t0"), F.max(F.array_max(F.transform("signal", F.size))).alias("t1"),
        F.count_if(F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
        F.count_if(F.col("label").isNull() | F.col("subject").isNull()).alias("holes"),
        F.countDistinct("label").alias("classes"),
    ).first()
    if not r["n"] or r["c0"] < 1 or r["t0"] < 1:
        raise ValueError("a trial table must not be empty")
    if r["c0"] != r["c1"] or r["t0"] != r["t1"]:
        raise ValueError("trials differ in shape")
    if r["bad"] or r["holes"]:
        raise ValueError(f"{r['bad']} trials that are not finite, {r['holes']} without label or subject")
    if r["classes"] < 2:
        raise ValueError("two classes are needed")
    if r["t0"] <= r["c0"]:
        hint = "; are the axes transposed?" if r["c0"] > 4 * r["t0"] else ""
        raise ValueError(f"{r['c0']} channels need more than {r['t0']} samples{hint}")
    if r["t0"] / r["c0"] < MIN_RATIO:
        log.warning("only %.2f samples for each channel: covariances will be poorly conditioned", r["t0"] / r["c0"])
    return {"n_trials": r["n"], "n_channels": r["c0"], "n_times": r["t0"], "n_classes": r["classes"]}


def summary(trials: DataFrame) -> Summary:
    shape = validate(trials)
    labels = {r["label"]: r["count"] for r in trials.groupBy("label").count().collect()}
    subjects = {r["subject"]: r["count"] for r in trials.groupBy("subject").count().collect()}
    balance = {k: v / shape["n_trials"] for k, v in sorted(labels.items())}
    return Summary(**shape, n_subjects=len(subjects), chance_accuracy=max(balance.values()), class_balance=balance, trials_per_subject=dict(sorted(subjects.items())))


def select_subjects(trials: DataFrame, subjects: list) -> DataFrame:
    """Rows of some subjects; one that isn't there is an error."""
    there = {r[0] for r in trials.select("subject").where(F.col("subject").isin(subjects)).distinct().collect()}
    if missing := [s for s in subjects if s not in there]:
        raise ValueError(f"no such subjects: {missing}")
    return trials.where(F.col("subject").isin(subjects))


def take(trials: DataFrame, positions: list[int]) -> DataFrame:
    """Rows by position in trial_id order, in the given order and as often as given; ``position`` says where."""
    from covarium.operators.rank import average_rank

    spark = trials.sparkSession
    wanted = spark.createDataFrame([(int(p), k) for k, p in enumerate(positions)], "at long, position int")
    ranked = average_rank(trials, "trial_id", "at").withColumn("at", (F.col("at") - 1).cast("long"))
    return ranked.join(F.broadcast(wanted), "at").drop("at").orderBy("position")


_loaders: dict[str, Callable[..., DataFrame]] = {}


def register_dataset(name: str):
    def keep(loader: Callable[..., DataFrame]):
        if name in _loaders:
            raise ValueError(f"{name!r} is registered already")
        _loaders[name] = loader
        return loader

    return keep


def load_dataset(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _loaders:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(_loaders))}")
    return _loaders[name](spark, **options)


def available_datasets() -> list[str]:
    return sorted(_loaders)


@register_dataset("synthetic")
def make_synthetic(
    spark: SparkSession, *, n_subjects: int = 9, n_trials_per_subject: int = 72, n_channels: int = 22, n_times: int = 500, n_classes: int = 2,
    task_effect: float = 0.35, subject_variability: float = 1.0, drift: float = 0.15, source_decay: float = 3.0, seed: int = 0,
) -> DataFrame:
    """Seeded trials: a subject's shift, a slow drift and a class pattern mix sources of falling power. A generator for each subject."""
    base = np.random.default_rng([seed, 0])
    mixing = np.linalg.qr(base.standard_normal((n_channels, n_channels)))[0] * np.sqrt(np.exp(-np.arange(n_channels) / source_decay))
    patterns = base.standard_normal((n_classes, n_channels, n_channels)) / np.sqrt(n_channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["s"].iloc[0])
        rng = np.random.default_rng([seed, 1, s])
        shift = subject_variability * rng.standard_normal((n_channels, n_channels)) / np.sqrt(n_channels) / 2
        state, rows = np.zeros((n_channels, n_channels)), []
        for t in range(n_trials_per_subject):
            state = 0.95 * state + drift * rng.standard_normal((n_channels, n_channels)) / np.sqrt(n_channels)
            label = t % n_classes
            operator = np.eye(n_channels) + shift + state + task_effect * patterns[label]
            epoch = operator @ mixing @ rng.standard_normal((n_channels, n_times))
            rows.append((s * n_trials_per_subject + t, f"S{s + 1:02d}", str(int(t >= n_trials_per_subject / 2)), label, list(epoch)))
        return pd.DataFrame(rows, columns=["trial_id", "subject", "session", "label", "signal"])

    return spark.range(n_subjects).select(F.col("id").alias("s")).groupBy("s").applyInPandas(run, SCHEMA)


def embedding_trials(spark: SparkSession, sf_dir: str, channels: int = 2) -> DataFrame:
    """The embeddings as trials: 64 numbers as ``channels`` rows, subject ``vec_id % 5``, label ``label % 2``."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    width = 64 // channels
    signal = F.array(*(F.slice(e, 1 + k * width, width) for k in range(channels)))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("trial_id"), (F.col("vec_id") % 5).alias("subject"), (F.col("label") % 2).alias("label"), signal.alias("signal"))


def cache_key(parameters: dict) -> str:
    """Sixteen hex digits that any change of a parameter, order of channels included, alters."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, name: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet cache: read what an earlier run committed under the same parameters, else make and write it."""
    path = f"{root}/name={name}/key={cache_key(parameters)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
