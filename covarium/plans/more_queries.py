"""Further queries, registered beside those of ``queries``: matrix functions, splits, summaries, files and the runner."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from covarium.functions import matrices as M
from covarium.functions.distributions import chance_level
from covarium.operators import align, means, metrics, rank, splits
from covarium.plans import runner
from covarium.plans.config import ExperimentConfig
from covarium.plans.queries import EIGEN, MDM, TRIALS, covs, entries, query, r, rs, score_sql, table
from covarium.sources import results
from covarium.sources import trials as T
from covarium.sources.shards import ShardStore

# spectral functions by closed forms of 2 x 2 matrices

ROOT = EIGEN + ", w AS (SELECT *, sqrt(det) AS q, sqrt(a + d + 2 * sqrt(det)) AS z FROM h), v AS (SELECT *, (a + q) / z AS sa, b / z AS sb, (d + q) / z AS sd FROM w)"


@query(ROOT + f" SELECT trial_id, {rs('sa')} AS c11, {rs('sb')} AS c12, {rs('sd')} AS c22 FROM v")
def square_root(spark, d):
    return entries(covs(spark, d).withColumn("m", M.sqrtm("cov")), "m", "trial_id")


@query(ROOT + f" SELECT trial_id, {rs('sd / q', 6)} AS c11, {rs('-sb / q', 6)} AS c12, {rs('sa / q', 6)} AS c22 FROM v")
def inverse_square_root(spark, d):
    x = covs(spark, d).withColumn("m", M.invsqrtm("cov"))
    return x.select("trial_id", *(r(F.get("m", F.lit(k)), 6).alias(n) for k, n in ((0, "c11"), (1, "c12"), (3, "c22"))))


@query(EIGEN + ", p AS (SELECT *, (h ** 0.3 - l ** 0.3) / (h - l) AS k FROM h)" + f" SELECT trial_id, {rs('h ** 0.3 + k * (a - h)')} AS c11, {rs('k * b')} AS c12, {rs('h ** 0.3 + k * (d - h)')} AS c22 FROM p")
def matrix_power(spark, d):
    return entries(covs(spark, d).withColumn("m", M.powm("cov", 0.3)), "m", "trial_id")


@query(
    EIGEN + ", i AS (SELECT *, h - (a + d) / 2 AS top, l - (a + d) / 2 AS low FROM h), f AS (SELECT *, (top - greatest(low, 0.001 * top)) / (h - l) AS k FROM i)"
    f" SELECT trial_id, {rs('top + k * (a - h)')} AS c11, {rs('k * b')} AS c12, {rs('top + k * (d - h)')} AS c22 FROM f"
)
def nearest_positive(spark, d):
    """A matrix shifted until it has a negative eigenvalue, projected to those of a thousandth of the largest and more."""
    half = (F.get("cov", F.lit(0)) + F.get("cov", F.lit(3))) / 2
    shifted = F.transform("cov", lambda x, k: F.when(k % 3 == 0, x - half).otherwise(x))
    return entries(covs(spark, d).withColumn("m", M.project(shifted, 1e-3)), "m", "trial_id")


@query(TRIALS + f" SELECT trial_id, {rs('a', 6)} AS c11, {rs('b', 6)} AS c12, {rs('d', 6)} AS c22 FROM c")
def tangent_and_back(spark, d):
    """Tangent vectors at the log-Euclidean mean of all, mapped back to matrices."""
    df = covs(spark, d)
    space = align.TangentSpace("logeuclid").fit(df)
    back = space.inverse_transform(space.transform(df).drop("cov"))
    return back.select("trial_id", *(r(F.get("cov", F.lit(k)), 6).alias(n) for k, n in ((0, "c11"), (1, "c12"), (3, "c22"))))


@query(TRIALS + " SELECT trial_id, trial_id % 3 > 0 AS symmetric, b * b < a * d AS positive FROM c")
def symmetry_and_definiteness(spark, d):
    bent = F.transform("cov", lambda x, k: F.when((k == 1) & (F.col("trial_id") % 3 == 0), x + 0.5).otherwise(x))
    return covs(spark, d).select("trial_id", M.is_symmetric(bent, 2).alias("symmetric"), M.is_spd("cov").alias("positive"))


@query("SELECT n, n * (n + 1) // 2 AS entries FROM (SELECT unnest([2, 3, 8, 22, 62]) AS n)")
def tangent_dimensions(spark, d):
    return spark.createDataFrame([(n,) for n in (2, 3, 8, 22, 62)], "n int").select("n", M.vector_dimension("n").cast("int").alias("entries"))


TURNED = EIGEN + """, ref AS (SELECT subject, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM c GROUP BY subject), e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS h, a * d - b * b AS det FROM ref),
p AS (SELECT x.subject AS i, y.subject AS j, (x.d * y.a - 2 * x.b * y.b + x.a * y.d) / x.det AS t, y.det / x.det AS q, ln(x.h) - ln(y.h) AS u, ln(x.det / x.h) - ln(y.det / y.h) AS v FROM e x JOIN e y ON x.subject < y.subject),
parts AS (SELECT i, j, ln((t + sqrt(greatest(t * t - 4 * q, 0))) / 2) ** 2 + ln(q / ((t + sqrt(greatest(t * t - 4 * q, 0))) / 2)) ** 2 AS whole, u * u + v * v AS still FROM p)"""


@query(TURNED + f" SELECT i, j, {rs('sqrt(whole)', 6)} AS total, {rs('sqrt(still)', 6)} AS spectral FROM parts")
def rotation_split_batched(spark, d):
    """The kernel for matrices of any size, on the subjects' Euclidean means."""
    refs = means.mean_euclid(covs(spark, d), ["subject"])
    split = means.upper_pairs(refs, "subject", "cov", align.rotation_split("a", "b", 3))
    return split.select("i", "j", r("value.total", 6).alias("total"), r("value.spectral", 6).alias("spectral"))


# trials, splits and metrics


@query(TRIALS + " SELECT count(*) AS n_trials, 2 AS n_channels, 32 AS n_times, count(DISTINCT label)::INT AS n_classes, 16.0::DOUBLE AS samples_per_channel FROM t")
def trial_shapes(spark, d):
    shape = T.validate(T.embedding_trials(spark, d, 2))
    return spark.createDataFrame([(*shape.values(), shape["n_times"] / shape["n_channels"])], "n_trials long, n_channels int, n_times int, n_classes int, samples_per_channel double")


@query(TRIALS + ", n AS (SELECT *, row_number() OVER (ORDER BY trial_id) - 1 AS place FROM t) SELECT k::INT AS position, trial_id, subject, label FROM n JOIN (SELECT unnest([7, 3, 7, 0]) AS place, unnest([0, 1, 2, 3]) AS k) USING (place)")
def take_positions(spark, d):
    return T.take(T.embedding_trials(spark, d), [7, 3, 7, 0]).select("position", "trial_id", "subject", "label")


@query(TRIALS + " SELECT fold, count(*) AS n FROM (SELECT ((row_number() OVER () - 1) * 7 // count(*) OVER ())::INT AS fold FROM t) GROUP BY fold")
def leaky_fold_sizes(spark, d):
    """The control's folds are a permutation cut evenly, whatever the seed."""
    folds = splits.LeakyShuffleSplit(7, random_state=5, acknowledge_leakage=True).split(T.embedding_trials(spark, d))
    return folds.where("role = 'test'").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(TRIALS + " SELECT 'kfold' AS name, 4 AS folds, false AS independent, false AS disjoint UNION ALL SELECT 'chronological', 3, false, true UNION ALL SELECT 'loso', count(DISTINCT subject)::INT, true, true FROM t")
def splitter_guarantees(spark, d):
    df = T.embedding_trials(spark, d)
    made = {"kfold": {"n_splits": 4}, "chronological": {"n_splits": 3}, "loso": {}}
    rows = [(k, s.n_splits(df), s.info.subject_independent, s.info.temporally_disjoint) for k, s in ((k, splits.make_splitter(k, **p)) for k, p in made.items())]
    return spark.createDataFrame(rows, "name string, folds int, independent boolean, disjoint boolean")


@query("SELECT * FROM (VALUES (20, 0.7::DOUBLE), (40, 0.625), (80, 0.5875), (288, 0.5486)) AS v(n, level)")
def chance_levels(spark, d):
    return spark.createDataFrame([(n, round(chance_level(n, 2, 0.05), 4)) for n in (20, 40, 80, 288)], "n int, level double")


@query(
    "WITH p AS (SELECT vec_id, label % 3 AS y, unnest([0, 1, 2]) AS k, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]) AS s FROM embeddings),"
    " k AS (SELECT k, y = k AS hit, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS place FROM p),"
    " a AS (SELECT k, sum(place) FILTER (hit) AS total, count(*) FILTER (hit) AS n, count(*) FILTER (NOT hit) AS m FROM k GROUP BY k)"
    f" SELECT {rs('avg((total - n * (n + 1) / 2) / (n::DOUBLE * m))')} AS roc_auc FROM a"
)
def roc_auc_of_three_classes(spark, d):
    """One against the rest, averaged; the first three numbers of a vector stand for probabilities."""
    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("y_true"), F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3).alias("proba"))
    return metrics.roc_auc_of_probabilities(e, classes=[0, 1, 2]).select(r("roc_auc").alias("roc_auc"))


# result tables

DESCRIBED = "count({v}) AS n, " + ", ".join(f"{rs(e, 4)} AS {n}" for e, n in (("avg({v})", "mean"), ("stddev_samp({v})", "std"), ("min({v})", "least"), ("quantile_cont({v}, 0.25)", "q25"), ("quantile_cont({v}, 0.5)", "q50"), ("quantile_cont({v}, 0.75)", "q75"), ("max({v})", "most")))


@query("SELECT event_type, " + DESCRIBED.format(v="value") + " FROM events GROUP BY event_type")
def described(spark, d):
    out = rank.describe(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(r(c, 4).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most")))


@query(f"SELECT c_mktsegment, {rs('regr_slope(c_acctbal, c_nationkey)', 6)} AS slope, {rs('sqrt((regr_syy(c_acctbal, c_nationkey) - regr_slope(c_acctbal, c_nationkey) ** 2 * regr_sxx(c_acctbal, c_nationkey)) / (count(*) - 2) / regr_sxx(c_acctbal, c_nationkey))', 6)} AS se, count(*) AS n FROM customer GROUP BY c_mktsegment")
def slope_errors(spark, d):
    return rank.slope_error(table(spark, d, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", r("slope", 6).alias("slope"), r("se", 6).alias("se"), "n")


@query(f"SELECT event_id, {rs('value - (SELECT avg(z.value) FROM events z WHERE z.event_type = ' + repr('view') + ' AND z.user_id = e.user_id)', 6)} AS over FROM events e WHERE event_type = 'purchase'")
def over_reference(spark, d):
    """What a column is above a reference cross-section of its group; null where the group has none."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    base = e.where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("base"))
    return e.where("event_type = 'purchase'").join(base, "user_id", "left").select("event_id", r(F.col("value") - F.col("base"), 6).alias("over"))


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL) GROUP BY event_type")
def distinct_pairs(spark, d):
    """Duplicates and rows with holes dropped, then counted."""
    return table(spark, d, "events").dropna(subset=["value", "props"]).dropDuplicates(["event_type", "user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 5")
def sorted_heads(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", place.alias("place")).where("place <= 5")


@query(f"SELECT o_orderstatus, count(*) AS n, {rs('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY o_orderstatus")
def csv_glob(spark, d):
    """Result files of three sweeps, written as CSV and read again by one glob."""
    from uuid import uuid4

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{shared}/covarium-csv-{uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    for k in range(3):
        results.write_csv(orders.where(F.col("o_orderkey") % 3 == k), f"{root}/sweep={k}")
    back = results.read_csv(spark, f"{root}/sweep=*", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


# the evaluator and the runner

FOLDED = MDM + ", sized AS (SELECT fold, count(*) AS n_test, (SELECT count(*) FROM t) - count(*) AS n_train FROM pred GROUP BY fold)"


def scored_sql() -> str:
    inner = score_sql(FOLDED, "fold", "accuracy, balanced_accuracy, kappa")
    head, tail = inner.rsplit("\nSELECT ", 1)
    return f"{head}, done AS (SELECT {tail})\nSELECT fold, n_train, n_test, accuracy, balanced_accuracy, kappa FROM done JOIN sized USING (fold)"


def _rounded(frame):
    return frame.select(F.col("fold").cast("int").alias("fold"), F.col("n_train").cast("long").alias("n_train"), F.col("n_test").cast("long").alias("n_test"), *(r(m).alias(m) for m in ("accuracy", "balanced_accuracy", "kappa")))


NEAREST = [("mdm", {"metric": "logeuclid", "n": 2})]


@query(scored_sql())
def evaluated_frame(spark, d):
    """The evaluator's result as a table: a nearest-centroid pipeline over folds that leave a subject out."""
    return _rounded(runner.evaluate(NEAREST, covs(spark, d), splits.LeaveOneSubjectOut()).to_frame(spark))


@query(scored_sql())
def experiment_frame(spark, d):
    """A run from a specification: covariances, folds, a shard for each, and the result read from the shards."""
    with tempfile.TemporaryDirectory() as root:
        config = ExperimentConfig(
            name="embeddings", dataset={"name": "embeddings"}, pipeline={"steps": [{"name": "covariances"}, *({"name": n, "params": p} for n, p in NEAREST)]},
            statistics={"n_bootstrap": 0}, runtime={"output_root": root},
        )
        done = runner.run_experiment(spark, config, T.embedding_trials(spark, d, 2))
        if ShardStore(Path(done.path) / "shards").to_frame(spark).count() != done.n_units:
            raise RuntimeError("a fold has no shard")
        return _rounded(done.result.to_frame(spark))
