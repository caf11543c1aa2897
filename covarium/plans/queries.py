"""The engine's queries over the driver's tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covarium.functions import linalg
from covarium.functions import matrices as M
from covarium.functions import statevector as S
from covarium.operators import align, classify, compare, kernels, means, metrics, rank, splits
from covarium.session import ship_package
from covarium.sources import trials as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL of the same views: trials of two channels, and their covariances (a b; b d)
TRIALS = """WITH t AS (SELECT vec_id AS trial_id, vec_id % 5 AS subject, label % 2 AS label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT trial_id, subject, label, e, e[1:32] AS x, e[33:64] AS y FROM t),
c AS (SELECT trial_id, subject, label, list_dot_product(x, x) / 32 - list_avg(x) * list_avg(x) AS a, list_dot_product(x, y) / 32 - list_avg(x) * list_avg(y) AS b,
 list_dot_product(y, y) / 32 - list_avg(y) * list_avg(y) AS d FROM s)"""
EIGEN = TRIALS + """, g AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS h, a * d - b * b AS det FROM c), h AS (SELECT *, det / h AS l FROM g),
lg AS (SELECT *, (ln(h) - ln(l)) / (h - l) AS beta FROM h), m AS (SELECT *, ln(h) - beta * h + beta * a AS la, beta * b AS lb, ln(h) - beta * h + beta * d AS ld FROM lg)"""
#: exponential of a symmetric (p q; q r) as three columns
EXP = """SELECT {keys}, exp(mid + half) - beta * (mid + half) + beta * p AS ra, beta * q AS rb, exp(mid + half) - beta * (mid + half) + beta * r AS rd
FROM (SELECT *, (exp(mid + half) - exp(mid - half)) / (2 * half) AS beta FROM (SELECT *, (p + r) / 2 AS mid, sqrt((p - r) * (p - r) / 4 + q * q) AS half FROM ({src})))"""
REFS = EIGEN + ", ref AS (" + EXP.format(keys="subject", src="SELECT subject, avg(la) AS p, avg(lb) AS q, avg(ld) AS r FROM m GROUP BY subject") + ")"
AIRM = """sqrt(ln(({t} + sqrt(greatest({t} * {t} - 4 * {d}, 0))) / 2) ** 2 + ln({d} / (({t} + sqrt(greatest({t} * {t} - 4 * {d}, 0))) / 2)) ** 2)"""


def airm_sql(x: str, y: str) -> str:
    det = f"({x}a * {x}d - {x}b * {x}b)"
    return AIRM.format(t=f"(({x}d * {y}a - 2 * {x}b * {y}b + {x}a * {y}d) / {det})", d=f"(({y}a * {y}d - {y}b * {y}b) / {det})")


def r(x: Column | str, digits: int = 8) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rs(x: str, digits: int = 8) -> str:
    return f"round({x}, {digits}) + 0.0"


def query(oracle: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial_id, subject, label, cov``: native covariances of two-channel trials."""
    return T.embedding_trials(spark, sf_dir, 2).select("trial_id", "subject", "label", M.scm("signal", 2).alias("cov"))


def covs4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.embedding_trials(spark, sf_dir, 4).select("trial_id", "subject", "label", M.scm("signal", 4).alias("cov"))


def entries(df: DataFrame, matrix: str, *keys: str, names=("c11", "c12", "c22")) -> DataFrame:
    return df.select(*keys, *(r(F.get(matrix, F.lit(k))).alias(n) for k, n in zip((0, 1, 3), names)))


# trials and entrywise functions


@query(TRIALS + f" SELECT trial_id, {rs('a')} AS c11, {rs('b')} AS c12, {rs('d')} AS c22 FROM c")
def scm_covariance(spark, d):
    return entries(covs(spark, d), "cov", "trial_id")


@query(TRIALS + " SELECT subject, count(*) AS n FROM t GROUP BY subject")
def trials_per_subject(spark, d):
    return T.embedding_trials(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query(TRIALS + f" SELECT label, {rs('count(*) / (SELECT count(*) FROM t)')} AS proportion FROM t GROUP BY label")
def class_balance(spark, d):
    return metrics.class_balance(T.embedding_trials(spark, d)).select("label", r("proportion").alias("proportion"))


@query(TRIALS + f" SELECT {rs('max(n) / sum(n)')} AS chance_accuracy FROM (SELECT count(*) AS n FROM t GROUP BY label)")
def chance_accuracy(spark, d):
    return metrics.chance_accuracy(T.embedding_trials(spark, d)).select(r("chance_accuracy").alias("chance_accuracy"))


@query(TRIALS + " SELECT trial_id, subject FROM t WHERE subject IN (1, 3)")
def select_subjects(spark, d):
    return T.select_subjects(T.embedding_trials(spark, d), [1, 3]).select("trial_id", "subject")


@query(TRIALS + f" SELECT trial_id, {rs('a + 0.001 * (a + d) / 2')} AS c11, {rs('b')} AS c12, {rs('d + 0.001 * (a + d) / 2')} AS c22 FROM c")
def symmetrize_trace_ridge(spark, d):
    return entries(covs(spark, d).withColumn("m", M.regularize(M.symmetrize("cov", 2), 2, 1e-3)), "m", "trial_id")


@query(TRIALS + f" SELECT trial_id, {rs('0.75 * a + 0.25 * (a + d) / 2')} AS c11, {rs('0.75 * b')} AS c12, {rs('0.75 * d + 0.25 * (a + d) / 2')} AS c22 FROM c")
def shrink_identity(spark, d):
    return entries(covs(spark, d).withColumn("m", M.shrink("cov", 2, 0.25)), "m", "trial_id")


@query(TRIALS + f" SELECT trial_id, {rs('a')} AS v1, {rs('b * sqrt(2)')} AS v2, {rs('d')} AS v3, {rs('sqrt(a * a + 2 * b * b + d * d)')} AS norm, true AS returns FROM c")
def vech_isometry(spark, d):
    v = covs(spark, d).withColumn("v", M.vech("cov", 2))
    back = M.euclid(M.unvech("v", 2), "cov") < 1e-12
    return v.select("trial_id", *(r(F.get("v", F.lit(k))).alias(f"v{k + 1}") for k in range(3)), r(F.sqrt(M.dot(F.col("v"), F.col("v")))).alias("norm"), back.alias("returns"))


# spectral functions of 2 x 2 matrices


@query(EIGEN + f" SELECT trial_id, {rs('ln(det)')} AS logdet FROM h")
def logdet_2x2(spark, d):
    return covs(spark, d).select("trial_id", r(M.logdet2("cov")).alias("logdet"))


@query(EIGEN + f" SELECT trial_id, {rs('h / l')} AS kappa FROM h")
def condition_number_2x2(spark, d):
    return covs(spark, d).select("trial_id", r(M.condition2("cov")).alias("kappa"))


@query(EIGEN + f" SELECT count(*) FILTER (h / l > 1.5) AS n_over, {rs('median(h / l)')} AS med, {rs('max(h / l)')} AS worst FROM h")
def condition_audit(spark, d):
    k = covs(spark, d).select(M.condition2("cov").alias("k"))
    return k.agg(F.count_if(F.col("k") > 1.5).alias("n_over"), r(F.median("k")).alias("med"), r(F.max("k")).alias("worst"))


@query(EIGEN + f" SELECT trial_id, {rs('la')} AS c11, {rs('lb')} AS c12, {rs('ld')} AS c22 FROM m")
def logm_2x2(spark, d):
    return entries(covs(spark, d).withColumn("m", M.logm2("cov")), "m", "trial_id")


@query(EIGEN + f" SELECT trial_id, {rs('la')} AS c11, {rs('lb')} AS c12, {rs('ld')} AS c22 FROM m")
def logm_batched(spark, d):
    """The general kernel on the same matrices."""
    return entries(covs(spark, d).withColumn("m", M.logm("cov")), "m", "trial_id")


@query(EIGEN + f" SELECT trial_id, {rs('ln(det)')} AS logdet, {rs('h / l')} AS kappa, true AS spd FROM h")
def scalars_batched(spark, d):
    return covs(spark, d).select("trial_id", r(M.logdet("cov")).alias("logdet"), r(M.condition_number("cov")).alias("kappa"), M.is_spd("cov").alias("spd"))


@query(TRIALS + f" SELECT trial_id, {rs('d / (a * d - b * b)', 6)} AS i11, {rs('-b / (a * d - b * b)', 6)} AS i12, {rs('a / (a * d - b * b)', 6)} AS i22 FROM c")
def inverse_batched(spark, d):
    x = covs(spark, d).withColumn("m", M.inv("cov"))
    return x.select("trial_id", *(r(F.get("m", F.lit(k)), 6).alias(n) for k, n in ((0, "i11"), (1, "i12"), (3, "i22"))))


# means, distances, alignment


@query(TRIALS + f" SELECT subject, {rs('avg(a)')} AS c11, {rs('avg(b)')} AS c12, {rs('avg(d)')} AS c22 FROM c GROUP BY subject")
def mean_euclid(spark, d):
    return entries(means.mean_euclid(covs(spark, d), ["subject"]), "cov", "subject")


@query(REFS + f" SELECT subject, {rs('ra')} AS c11, {rs('rb')} AS c12, {rs('rd')} AS c22 FROM ref")
def mean_logeuclid(spark, d):
    return entries(means.mean_logeuclid(covs(spark, d), ["subject"]), "cov", "subject")


def to_reference(spark, d):
    df = covs(spark, d)
    return df.join(align.domain_references(df, metric="logeuclid", n=2), "subject")


JOINED = REFS + ", j AS (SELECT m.*, ra, rb, rd FROM m JOIN ref USING (subject))"


@query(JOINED + f" SELECT trial_id, {rs(airm_sql('r', 'j.'), 7)} AS distance FROM j")
def dist_airm(spark, d):
    return to_reference(spark, d).select("trial_id", r(M.airm2("reference", "cov"), 7).alias("distance"))


@query(JOINED + f" SELECT trial_id, {rs(airm_sql('r', 'j.'), 7)} AS distance FROM j")
def dist_airm_batched(spark, d):
    return to_reference(spark, d).select("trial_id", r(M.distance("reference", "cov"), 7).alias("distance"))


STEIN = "sqrt(greatest(ln((a + ra) / 2 * (d + rd) / 2 - ((b + rb) / 2) ** 2) - 0.5 * ln(det * (ra * rd - rb * rb)), 0))"


@query(JOINED + f" SELECT trial_id, {rs(STEIN, 6)} AS distance FROM j")
def dist_stein(spark, d):
    return to_reference(spark, d).select("trial_id", r(M.stein2("reference", "cov"), 6).alias("distance"))


@query(JOINED + f" SELECT trial_id, {rs('sqrt((a - ra) ** 2 + 2 * (b - rb) ** 2 + (d - rd) ** 2)')} AS distance FROM j")
def dist_euclid(spark, d):
    return to_reference(spark, d).select("trial_id", r(M.euclid("reference", "cov")).alias("distance"))


@query(EIGEN + f", z AS (SELECT subject, avg(la) AS ea, avg(lb) AS eb, avg(ld) AS ed FROM m GROUP BY subject) SELECT trial_id, {rs('sqrt((la - ea) ** 2 + 2 * (lb - eb) ** 2 + (ld - ed) ** 2)', 7)} AS distance FROM m JOIN z USING (subject)")
def dist_logeuclid(spark, d):
    return to_reference(spark, d).select("trial_id", r(M.logeuclid2("reference", "cov"), 7).alias("distance"))


PAIRS = REFS + f", p AS (SELECT x.subject AS i, y.subject AS j, {airm_sql('x.r', 'y.r')} AS value FROM ref x JOIN ref y ON x.subject < y.subject)"


@query(PAIRS + f" SELECT i, j, {rs('value', 7)} AS value FROM p")
def pairwise_upper(spark, d):
    refs = align.domain_references(covs(spark, d), metric="logeuclid", n=2)
    return means.upper_pairs(refs, "subject", "reference", M.airm2("a", "b")).select("i", "j", r("value", 7).alias("value"))


@query(TRIALS + f" SELECT x.trial_id AS i, y.trial_id AS j, {rs('sqrt((x.a - y.a) ** 2 + 2 * (x.b - y.b) ** 2 + (x.d - y.d) ** 2)')} AS value FROM c x, c y")
def pairwise_matrix(spark, d):
    """The whole distance matrix, mirrored and with its zero diagonal."""
    return means.pairwise_distances(covs(spark, d), metric="euclid", n=2).select("i", "j", r("value").alias("value"))


@query(PAIRS + f" SELECT {rs('avg(value)', 7)} AS mean_distance FROM p")
def inter_subject_distance(spark, d):
    return align.inter_subject_distance(covs(spark, d), n=2, mean_metric="logeuclid").select(r("mean_distance", 7).alias("mean_distance"))


@query(PAIRS + f" SELECT subject, {rs('avg(value)', 7)} AS displacement FROM (SELECT i AS subject, value FROM p UNION ALL SELECT j, value FROM p) GROUP BY subject")
def subject_displacements(spark, d):
    return align.subject_displacements(covs(spark, d), n=2, mean_metric="logeuclid").select("subject", r("displacement", 7).alias("displacement"))


@query(JOINED + f" SELECT trial_id, {rs('(rd * a - 2 * rb * b + ra * d) / (ra * rd - rb * rb)', 7)} AS trace, {rs('ln(det) - ln(ra * rd - rb * rb)', 7)} AS logdet FROM j")
def recenter_invariants(spark, d):
    """Trace and log-determinant of the re-centred matrices, which don't depend on the root taken."""
    out = align.align_domains(covs(spark, d), metric="logeuclid", n=2)
    return out.select("trial_id", r(M.trace("cov", 2), 7).alias("trace"), r(M.logdet2("cov"), 7).alias("logdet"))


@query(JOINED + f" SELECT subject, {rs('avg(' + airm_sql('r', 'j.') + ' ** 2)', 7)} AS dispersion FROM j GROUP BY subject")
def dispersion(spark, d):
    df = covs(spark, d)
    return align.dispersion(df, align.domain_references(df, metric="logeuclid", n=2), n=2).select("subject", r("dispersion", 7).alias("dispersion"))


@query(
    REFS + ", e AS (SELECT *, (ra + rd) / 2 + sqrt((ra - rd) ** 2 / 4 + rb * rb) AS h2, ra * rd - rb * rb AS det2 FROM ref), f AS (SELECT *, det2 / h2 AS l2 FROM e),"
    f" q AS (SELECT x.subject AS i, y.subject AS j, {airm_sql('x.r', 'y.r')} AS total, sqrt((ln(x.h2) - ln(y.h2)) ** 2 + (ln(x.l2) - ln(y.l2)) ** 2) AS spectral FROM f x JOIN f y ON x.subject < y.subject)"
    f" SELECT i, j, {rs('total', 6)} AS total, {rs('spectral', 6)} AS spectral FROM q"
)
def rotation_split(spark, d):
    refs = align.domain_references(covs(spark, d), metric="logeuclid", n=2)
    split = means.upper_pairs(refs, "subject", "reference", align.rotation_split("a", "b"))
    return split.select("i", "j", r("value.total", 6).alias("total"), r("value.spectral", 6).alias("spectral"))


# splits


@query(TRIALS + " SELECT (f.subject)::INT AS fold, t.trial_id, CASE WHEN t.subject = f.subject THEN 'test' ELSE 'train' END AS role FROM t, (SELECT DISTINCT subject FROM t) f")
def loso_folds(spark, d):
    return splits.LeaveOneSubjectOut().split(T.embedding_trials(spark, d)).select("fold", "trial_id", "role")


@query(
    TRIALS + """, w AS (SELECT trial_id, row_number() OVER (PARTITION BY subject ORDER BY trial_id) - 1 AS p, count(*) OVER (PARTITION BY subject) AS n FROM t),
k AS (SELECT *, greatest(1, least(n - 1, floor(0.5 * n + fold * (n - 0.5 * n) / 2))) AS cut, floor(0.5 * n + (fold + 1) * (n - 0.5 * n) / 2) AS e FROM w, (SELECT unnest([0, 1])::INT AS fold)),
z AS (SELECT *, greatest(cut + 1, least(n, e)) AS stop FROM k)
SELECT fold, trial_id, CASE WHEN p < cut THEN 'train' ELSE 'test' END AS role FROM z WHERE p < stop"""
)
def chronological_folds(spark, d):
    return splits.WithinSubjectChronological(0.5, 2).split(T.embedding_trials(spark, d))


@query(TRIALS + ", b AS (SELECT trial_id, (ntile(5) OVER (PARTITION BY subject ORDER BY trial_id) - 1)::INT AS block FROM t) SELECT fold, trial_id, CASE WHEN block = fold THEN 'test' ELSE 'train' END AS role FROM b, (SELECT unnest(range(5))::INT AS fold)")
def kfold_folds(spark, d):
    return splits.WithinSubjectKFold(5).split(T.embedding_trials(spark, d))


@query(TRIALS + " SELECT trial_id, (row_number() OVER (PARTITION BY subject ORDER BY trial_id) > count(*) OVER (PARTITION BY subject) // 2)::INT AS half FROM t")
def split_halves(spark, d):
    return splits.split_halves(T.embedding_trials(spark, d)).select("trial_id", "half")


@query(TRIALS + " SELECT trial_id FROM (SELECT trial_id, row_number() OVER (PARTITION BY subject, label ORDER BY md5('7:' || trial_id), trial_id) AS k FROM t) WHERE k <= 12")
def stratified_quota(spark, d):
    return splits.stratified_quota(T.embedding_trials(spark, d), ["subject", "label"], 12, seed=7).select("trial_id")


@query(TRIALS + " SELECT trial_id, ((dense_rank() OVER (ORDER BY subject) - 1) % 3)::INT AS fold FROM t")
def round_robin_folds(spark, d):
    return splits.fold_of(T.embedding_trials(spark, d), 3).select("trial_id", "fold")


# classification

MDM = EIGEN + """, tr AS (SELECT f.subject AS fold, m.label, avg(la) AS p, avg(lb) AS q, avg(ld) AS r FROM m, (SELECT DISTINCT subject FROM m) f WHERE m.subject <> f.subject GROUP BY 1, 2),
dist AS (SELECT m.subject AS fold, m.trial_id, m.label AS y_true, tr.label AS k, sqrt((la - p) ** 2 + 2 * (lb - q) ** 2 + (ld - r) ** 2) AS dist FROM m JOIN tr ON tr.fold = m.subject),
pred AS (SELECT fold::INT AS fold, trial_id, any_value(y_true) AS y_true, arg_min(k, dist) AS y_pred, min(dist) AS near, max(dist) AS far FROM dist GROUP BY fold, trial_id)"""


def loso_predictions(spark, d):
    df = covs(spark, d)
    return classify.mdm_fold_predictions(df, splits.LeaveOneSubjectOut().split(df))


@query(MDM + " SELECT fold, trial_id, y_true, y_pred FROM pred")
def mdm_logeuclid_predict(spark, d):
    return loso_predictions(spark, d).select("fold", "trial_id", "y_true", "y_pred")


@query(MDM + f" SELECT trial_id, {rs('1 / (1 + exp(near * near - far * far))', 7)} AS p_top FROM pred")
def mdm_softmax(spark, d):
    p = classify.softmax_of_distances(F.col("distances"))
    return loso_predictions(spark, d).select("trial_id", r(F.array_max(p), 7).alias("p_top"))


def score_sql(src: str, keys: str = "", cols: str = "n, accuracy, balanced_accuracy, kappa, f1_macro") -> str:
    by, k = (f" GROUP BY {keys}", f"{keys}, ") if keys else ("", "")
    using = f" JOIN cm USING ({keys})" if keys else ", cm"
    out = {"n": "n", "accuracy": rs("acc"), "balanced_accuracy": rs("bal"), "kappa": rs("CASE WHEN pe = 1 THEN 0 ELSE (acc - pe) / (1 - pe) END"), "f1_macro": rs("f1")}
    return f"""{src}, cl AS (SELECT {k}c, sum(t) AS t, sum(g) AS g, sum(h) AS h FROM (SELECT {k}y_true AS c, 1 AS t, 0 AS g, (y_true = y_pred)::INT AS h FROM pred UNION ALL SELECT {k}y_pred, 0, 1, 0 FROM pred) GROUP BY {k}c),
cm AS (SELECT {k}avg(CASE WHEN t > 0 THEN h / t END) AS bal, avg(2 * h / (t + g)) AS f1, sum(t::DOUBLE * g) AS chance FROM cl{by}),
al AS (SELECT {k}count(*) AS n, avg((y_true = y_pred)::INT) AS acc FROM pred{by}), fin AS (SELECT al.*, bal, f1, chance / n::DOUBLE / n AS pe FROM al{using})
SELECT {k}{', '.join(f'{out[c]} AS {c}' for c in cols.split(', '))} FROM fin"""


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *(r(m).alias(m) for m in metrics.LABEL_METRICS))


@query(score_sql(MDM, "fold"))
def loso_mdm_scores(spark, d):
    """The flagship: scan, covariance, fold means, nearest centroid, metrics, one plan for all folds."""
    return rounded(metrics.scores(loso_predictions(spark, d), ["fold"]), "fold")


PREDS = "WITH pred AS (SELECT quality AS y_true, toxic AS y_pred, lang FROM labels JOIN documents USING (doc_id))"


def preds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"), "lang", "n_chars")


@query(score_sql(PREDS))
def classification_metrics(spark, d):
    return rounded(metrics.scores(preds(spark, d)))


@query(score_sql(PREDS, "lang"))
def metrics_by_group(spark, d):
    return rounded(metrics.scores(preds(spark, d), ["lang"]), "lang")


@query("WITH p AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM p)" + f" SELECT {rs('(sum(rk) FILTER (y = 1) - (sum(y) * (sum(y) + 1) / 2)) / (sum(y) * (count(*) - sum(y)))')} AS roc_auc FROM k")
def roc_auc(spark, d):
    return metrics.roc_auc(preds(spark, d), (), "y_true", "n_chars").select(r("roc_auc").alias("roc_auc"))


# statistics over fold scores

FOLDS = "WITH fs AS (SELECT s_nationkey % 9 AS fold, avg(l_discount) AS sa, avg(l_tax) AS sb, count(*) AS n_test FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), df AS (SELECT *, sa - sb AS d FROM fs)"


def fold_scores(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_tax")
    sup = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 9).alias("fold"))
    return lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("fold").agg(F.avg("l_discount").alias("sa"), F.avg("l_tax").alias("sb"))


def fold_diffs(spark, d):
    f = fold_scores(spark, d)
    return compare.paired(f.select("fold", F.col("sa").alias("score")), f.select("fold", F.col("sb").alias("score")))


@query(FOLDS + f" SELECT k, {rs('m')} AS mean_diff, {rs('se')} AS se, {rs('m / se', 6)} AS t_stat, {rs('(1 - 3 / (4 * (k - 1) - 1)) * m / sd', 6)} AS hedges_g FROM (SELECT count(*) AS k, avg(d) AS m, stddev_samp(d) AS sd, sqrt((1 / count(*) + 288 / 2304) * var_samp(d)) AS se FROM df)")
def corrected_t_stat(spark, d):
    t = compare.corrected_t(fold_diffs(spark, d), (), 2304.0, 288.0)
    return t.select("k", r("mean_diff").alias("mean_diff"), r("se").alias("se"), r("t_stat", 6).alias("t_stat"), r("hedges_g", 6).alias("hedges_g"))


SIGNS = FOLDS + """, l AS (SELECT list(d ORDER BY d) AS ds, count(*)::INT AS k FROM df), f AS (SELECT ds, k, unnest(range((2 ** k)::BIGINT)) AS mask FROM l),
v AS (SELECT abs(list_sum([CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -ds[i] ELSE ds[i] END for i in range(1, k + 1)]) / k) AS nul, abs(list_sum(ds) / k) AS seen FROM f)"""


@query(SIGNS + f" SELECT {rs('avg(CASE WHEN nul >= seen - 1e-12 THEN 1 ELSE 0 END)')} AS p_value, count(*) AS n_flips FROM v")
def sign_flip_exact(spark, d):
    return compare.sign_flip_p(fold_diffs(spark, d)).select(r("p_value").alias("p_value"), "n_flips")


@query(FOLDS + f" SELECT fold, {rs('(sum(d) OVER () - d) / (count(*) OVER () - 1)')} AS loo_mean FROM df")
def jackknife(spark, d):
    return rank.jackknife(fold_diffs(spark, d)).select("fold", r("loo_mean").alias("loo_mean"))


PVALS = "WITH p AS (SELECT s_suppkey, s_nationkey % 3 AS family, (s_suppkey * 37 % 1009 + 1) / 5000.0::DOUBLE AS p_value FROM supplier), s AS (SELECT *, p_value * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value) + 1) AS sc FROM p)"


def p_values(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("family"), ((F.col("s_suppkey") * 37 % 1009 + 1) / F.lit(5000.0)).alias("p_value"))


@query(PVALS + f" SELECT s_suppkey, {rs('least(1, max(sc) OVER (PARTITION BY family ORDER BY p_value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM s")
def holm(spark, d):
    return compare.holm(p_values(spark, d), family=["family"]).select("s_suppkey", r("p_holm").alias("p_adjusted"))


@query(PVALS + f" SELECT s_suppkey, {rs('least(1, min(sc) OVER (PARTITION BY family ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS p_adjusted FROM s")
def hochberg(spark, d):
    return compare.hochberg(p_values(spark, d), family=["family"]).select("s_suppkey", r("p_hochberg").alias("p_adjusted"))


RANKS = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2"


@query(f"WITH k AS (SELECT {RANKS.format(x='c_acctbal')} AS a, {RANKS.format(x='c_nationkey')} AS b FROM customer) SELECT {rs('corr(a, b)')} AS rho, count(*) AS n FROM k")
def spearman(spark, d):
    return rank.spearman(table(spark, d, "customer"), "c_acctbal", "c_nationkey").select(r("rho").alias("rho"), "n")


@query(
    "WITH z AS (SELECT c_acctbal AS x, c_nationkey AS y, ln(c_custkey + 1) AS lz FROM customer), b AS (SELECT regr_slope(x, lz) AS sx, regr_intercept(x, lz) AS cx, regr_slope(y, lz) AS sy, regr_intercept(y, lz) AS cy FROM z),"
    f" e AS (SELECT x - cx - sx * lz AS u, y - cy - sy * lz AS v FROM z, b), k AS (SELECT {RANKS.format(x='u')} AS a, {RANKS.format(x='v')} AS b FROM e) SELECT {rs('corr(a, b)', 6)} AS rho FROM k"
)
def partial_spearman(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", "c_nationkey", (F.col("c_custkey") + 1).alias("z"))
    return rank.partial_spearman(c, "c_acctbal", "c_nationkey", "z").select(r("rho", 6).alias("rho"))


@query(f"SELECT c_mktsegment, {rs('regr_slope(c_acctbal, c_nationkey)', 6)} AS slope, {rs('regr_intercept(c_acctbal, c_nationkey)', 6)} AS intercept FROM customer GROUP BY c_mktsegment")
def ols_slope(spark, d):
    return rank.ols(table(spark, d, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", r("slope", 6).alias("slope"), r("intercept", 6).alias("intercept"))


# kernels

@query(TRIALS + f" SELECT p.trial_id AS i, q.trial_id AS j, {rs('list_product([cos(0.7 * (p.e[k] - q.e[k]) / 2) ** 2 for k in range(1, 65)])')} AS value FROM s p JOIN s q ON p.trial_id <= q.trial_id")
def angle_kernel(spark, d):
    return kernels.gram(features(spark, d), lambda x, y: kernels.angle_kernel(x, y, 0.7)).select("i", "j", r("value").alias("value"))


@query(TRIALS + f" SELECT p.trial_id AS i, q.trial_id AS j, {rs('exp(-0.5 * list_sum([(p.e[k] - q.e[k]) ** 2 for k in range(1, 65)]))')} AS value FROM s p JOIN s q ON p.trial_id <= q.trial_id")
def rbf_kernel(spark, d):
    return kernels.gram(features(spark, d), lambda x, y: kernels.rbf_kernel(x, y, 0.5)).select("i", "j", r("value").alias("value"))


@query(TRIALS + f", g AS (SELECT list_product([cos((p.e[k] - q.e[k]) / 2) ** 2 for k in range(1, 65)]) AS v FROM s p JOIN s q ON p.trial_id < q.trial_id) SELECT {rs('avg(v)')} AS mean, {rs('stddev_pop(v)')} AS std, count(*) AS n FROM g")
def kernel_concentration(spark, d):
    out = kernels.concentration(kernels.gram(features(spark, d), kernels.angle_kernel))
    return out.select(r("mean").alias("mean"), r("std").alias("std"), "n")


def features(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("trial_id"), (F.col("vec_id") % 5).alias("subject"), (F.col("label") % 2).alias("label"), x.alias("features"))


# the relational layer over result tables

KINDS = ["click", "error", "purchase", "signup", "view"]
WIDE = "WITH w AS (SELECT user_id, ts::DATE AS day, " + ", ".join(f"coalesce(sum(value) FILTER (event_type = '{k}'), 0) AS {k}" for k in KINDS) + " FROM events GROUP BY 1, 2)"


def events_wide(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).pivot("event_type", KINDS).agg(F.sum("value")).fillna(0.0)


@query(WIDE + ", c AS (SELECT " + ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for i, a in enumerate(KINDS) for b in KINDS[i:]) + " FROM w) SELECT " + ", ".join(rs(f"{a}_{b}", 6) + f" AS {a}_{b}" for i, a in enumerate(KINDS) for b in KINDS[i:]) + " FROM c")
def covariance_events(spark, d):
    """A covariance matrix of long-form data, as one aggregate."""
    return events_wide(spark, d).agg(*(r(F.covar_pop(a, b), 6).alias(f"{a}_{b}") for i, a in enumerate(KINDS) for b in KINDS[i:]))


@query(WIDE + " SELECT user_id, " + ", ".join(rs(f"avg({k})", 6) + f" AS {k}" for k in KINDS) + " FROM w GROUP BY user_id")
def pivot_subject_model(spark, d):
    return events_wide(spark, d).groupBy("user_id").agg(*(r(F.avg(k), 6).alias(k) for k in KINDS))


@query(f"SELECT event_id, {rs('m', 6)} AS group_mean FROM (SELECT event_id, avg(value) OVER (PARTITION BY user_id, event_type) AS m FROM events) WHERE m > 50")
def groupmean_joinback(spark, d):
    """Values are added by event_id, and rounded as DuckDB does: the double times a million, to the nearest whole number."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rows = rank.group_mean_join_back(e, ["user_id", "event_type"], "value", 50, order=["event_id"])
    return rows.select("event_id", (r(F.col("group_mean") * 1e6, 0) / 1e6).alias("group_mean"))


YEARS = "WITH y AS (SELECT o_orderpriority, year(o_orderdate)::INT AS yr, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def by_year(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.avg("o_totalprice").alias("v"))


@query(YEARS + f" SELECT o_orderpriority, yr, {rs('v - lag(v) OVER (PARTITION BY o_orderpriority ORDER BY yr)', 4)} AS gain FROM y")
def lag_gain(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("yr")
    return by_year(spark, d).select("o_orderpriority", "yr", r(F.col("v") - F.lag("v").over(w), 4).alias("gain"))


@query(YEARS + " SELECT o_orderpriority, arg_max(yr, v) AS best, arg_max(yr, yr) AS last FROM y GROUP BY 1")
def best_per_group(spark, d):
    return by_year(spark, d).groupBy("o_orderpriority").agg(F.max_by("yr", "v").alias("best"), F.max_by("yr", "yr").alias("last"))


@query(YEARS + f" SELECT o_orderpriority, {rs('avg(v)', 4)} AS mean_of_means, {rs('stddev_samp(v)', 4)} AS sd_of_means, {rs('min(v)', 4)} AS least, {rs('max(v)', 4)} AS most, count(DISTINCT yr) AS years FROM y GROUP BY 1")
def two_level_summary(spark, d):
    return by_year(spark, d).groupBy("o_orderpriority").agg(r(F.avg("v"), 4).alias("mean_of_means"), r(F.stddev_samp("v"), 4).alias("sd_of_means"), r(F.min("v"), 4).alias("least"), r(F.max("v"), 4).alias("most"), F.countDistinct("yr").alias("years"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def pending_units(spark, d):
    """What an earlier run hasn't done: an ordered difference as an anti-join."""
    done = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query(f"SELECT c_custkey, {rs('sum(o_totalprice)', 2)} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def reindexed_totals(spark, d):
    """A stored result laid over a list of keys; absent ones are null."""
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", r("total", 2).alias("total"))


@query("SELECT coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY ROLLUP (o_orderpriority)")
def prefix_total_row(spark, d):
    picked = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"))
    return picked.rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderpriority", F.lit("all")).alias("o_orderpriority"), "n")


# more of the same views

QUARTER = ["x1", "x2", "x3", "x4"]
FOUR = "WITH q AS (SELECT vec_id AS trial_id, " + ", ".join(f"embedding[{1 + 16 * k}:{16 * (k + 1)}]::DOUBLE[] AS {x}" for k, x in enumerate(QUARTER)) + " FROM embeddings)"
UPPER4 = [(i, j) for i in range(4) for j in range(i, 4)]


@query(FOUR + " SELECT trial_id, " + ", ".join(rs(f"list_dot_product({QUARTER[i]}, {QUARTER[j]}) / 16 - list_avg({QUARTER[i]}) * list_avg({QUARTER[j]})") + f" AS c{i + 1}{j + 1}" for i, j in UPPER4) + " FROM q")
def scm_covariance_4ch(spark, d):
    return covs4(spark, d).select("trial_id", *(r(F.get("cov", F.lit(4 * i + j))).alias(f"c{i + 1}{j + 1}") for i, j in UPPER4))


SHRUNK = TRIALS + """, v AS (SELECT c.*, (a + d) / 2 AS mu, a * a + 2 * b * b + d * d AS sq, list_avg([((x[k] - list_avg(x)) ** 2 + (y[k] - list_avg(y)) ** 2) ** 2 for k in range(1, 33)]) AS fourth FROM c JOIN s USING (trial_id)),
z AS (SELECT *, ((a - mu) ** 2 + 2 * b * b + (d - mu) ** 2) / 2 AS delta FROM v),
k AS (SELECT *, least(delta, (fourth - sq) / 64) / delta AS lw, least((sq / 4 + mu * mu) / (33 * (sq / 4 - mu * mu / 2)), 1) AS oa FROM z)"""


@query(SHRUNK + f" SELECT trial_id, {rs('(1 - lw) * a + lw * mu')} AS lw11, {rs('(1 - lw) * b')} AS lw12, {rs('(1 - oa) * a + oa * mu')} AS oas11, {rs('(1 - oa) * b')} AS oas12 FROM k")
def shrinkage_2ch(spark, d):
    t = T.embedding_trials(spark, d, 2).withColumn("lw", M.covariance("signal", "ledoit_wolf")).withColumn("oas", M.covariance("signal", "oas"))
    return t.select("trial_id", *(r(F.get(m, F.lit(k))).alias(f"{m}1{k + 1}") for m in ("lw", "oas") for k in (0, 1)))


@query(TRIALS + f" SELECT subject, {rs('sum(a * (1 + label)) / sum(1 + label)')} AS c11, {rs('sum(b * (1 + label)) / sum(1 + label)')} AS c12, {rs('sum(d * (1 + label)) / sum(1 + label)')} AS c22 FROM c GROUP BY subject")
def weighted_mean(spark, d):
    return entries(means.mean_euclid(covs(spark, d).withColumn("w", F.col("label") + 1.0), ["subject"], weight="w"), "cov", "subject")


@query(TRIALS + f" SELECT count(*) AS n_trials, count(DISTINCT subject) AS n_subjects, count(DISTINCT label) AS n_classes, {rs('greatest(avg(label), 1 - avg(label))')} AS chance FROM t")
def dataset_summary(spark, d):
    t = T.embedding_trials(spark, d)
    return t.agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("label").alias("n_classes"), r(F.greatest(F.avg("label"), 1 - F.avg("label"))).alias("chance"))


@query(EIGEN + f", z AS (SELECT avg(la) AS ea, avg(lb) AS eb, avg(ld) AS ed FROM m) SELECT trial_id, {rs('la - ea', 7)} AS t1, {rs('sqrt(2) * (lb - eb)', 7)} AS t2, {rs('ld - ed', 7)} AS t3 FROM m, z")
def tangent_logeuclid(spark, d):
    """Tangent vectors at the log-Euclidean mean of all trials."""
    df = covs(spark, d)
    out = align.TangentSpace("logeuclid").fit(df).transform(df)
    return out.select("trial_id", *(r(F.get("features", F.lit(k)), 7).alias(f"t{k + 1}") for k in range(3)))


KFOLD = EIGEN + """, b AS (SELECT trial_id, ntile(5) OVER (PARTITION BY subject ORDER BY trial_id) AS fold FROM t), mb AS (SELECT m.*, fold FROM m JOIN b USING (trial_id)),
tr AS (SELECT f.fold, mb.label, avg(la) AS p, avg(lb) AS q, avg(ld) AS r FROM mb, (SELECT DISTINCT fold FROM b) f WHERE mb.fold <> f.fold GROUP BY 1, 2),
dist AS (SELECT mb.trial_id, mb.subject, mb.label AS y_true, tr.label AS k, (la - p) ** 2 + 2 * (lb - q) ** 2 + (ld - r) ** 2 AS dist FROM mb JOIN tr USING (fold)),
pred AS (SELECT subject, trial_id, any_value(y_true) AS y_true, arg_min(k, dist) AS y_pred FROM dist GROUP BY subject, trial_id)"""


@query(score_sql(KFOLD, "subject"))
def oof_per_subject(spark, d):
    """Out-of-fold predictions of a block k-fold, scored by subject."""
    from covarium.operators import transfer

    df = covs(spark, d)
    out = classify.mdm_fold_predictions(df, splits.WithinSubjectKFold(5).split(df)).select("trial_id", "y_true", "y_pred")
    return rounded(transfer.per_subject_scores(out, df.select("trial_id", "subject")), "subject")


# what SQL can't say: iterative, spectral of larger matrices, seeded


@query()
def frechet_mean(spark, d):
    out = means.frechet_mean(covs4(spark, d), ["subject"])
    return out.select("subject", "n_iter", "converged", "n_rows", r(M.logdet("cov"), 6).alias("logdet"))


@query()
def frechet_mean_distributed(spark, d):
    out = means.distributed_mean(covs4(spark, d))
    return spark.createDataFrame([(out["n_iter"], out["converged"], float(round(linalg.logdet(out["mean"]), 6)))], "n_iter int, converged boolean, logdet double")


@query()
def tangent_space(spark, d):
    df = covs4(spark, d)
    return align.TangentSpace().fit(df).transform(df).select("trial_id", "features")


@query()
def geodesic_transport(spark, d):
    df = covs4(spark, d).join(means.frechet_mean(covs4(spark, d), ["subject"]).select("subject", F.col("cov").alias("ref")), "subject")
    out = df.withColumn("mid", M.geodesic("ref", "cov", 0.5)).withColumn("v", M.log_map("ref", "cov"))
    back = M.exp_map("ref", "v")
    moved = M.transport("ref", "mid", "v")
    return out.select("trial_id", r(M.distance("ref", "mid") / M.distance("ref", "cov"), 6).alias("share"), (M.euclid(back, "cov") < 1e-9).alias("returns"), moved.alias("moved"))


@query()
def shrinkage_covariances(spark, d):
    t = T.embedding_trials(spark, d, 4)
    return t.select("trial_id", *(r(M.condition_number(M.covariance("signal", e)), 6).alias(e) for e in ("scm", "ledoit_wolf", "oas")))


@query()
def aligned_quality(spark, d):
    df = covs4(spark, d)
    before, after = (align.alignment_quality(x).select(F.lit(n).alias("stage"), "*") for n, x in (("raw", df), ("aligned", align.align_domains(df))))
    return before.unionByName(after)


@query()
def lda_predict(spark, d):
    """A linear discriminant for each held-out subject."""
    df = features(spark, d)
    out = None
    for fold in sorted(x[0] for x in df.select("subject").distinct().collect()):
        model = classify.LinearDiscriminant(0.1).fit(df.where(F.col("subject") != fold))
        part = model.predict(df.where(F.col("subject") == fold)).select("trial_id", F.col("label").alias("y_true"), "y_pred")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def zz_fidelity_gram(spark, d):
    df = features(spark, d).withColumn("features", F.slice("features", 1, 6))
    return kernels.fidelity_gram(df, "zz", scale=1.0)


@query()
def iqp_fidelity_gram(spark, d):
    df = features(spark, d).withColumn("features", F.slice("features", 1, 6))
    return kernels.fidelity_gram(df, "iqp")


@query()
def kernel_classifier(spark, d):
    """A fidelity-kernel SVM for each held-out subject, solved by sums over rows."""
    df = features(spark, d)
    return kernels.FoldClassifier(4, scale=0.5).fit(df).predict(df)


@query()
def reuploading_circuit(spark, d):
    """Trained on the driver, as its steps follow one another, which holds two values and a label of each row; the executors tell all rows."""
    df = features(spark, d).select("trial_id", "label", *((F.get("features", F.lit(k)) * 3).alias(f"x{k}") for k in range(2)))
    rows = df.toArrow()
    order = np.argsort(rows["trial_id"].to_numpy(), kind="stable")
    x, y = (np.stack([rows[c].to_numpy()[order] for c in names], axis=1) for names in (("x0", "x1"), ("label",)))
    model = S.Reuploading(2, 2, epochs=3, batch=64).fit(x, y[:, 0].tolist())

    def tell(batches):
        for pdf in batches:
            yield pd.DataFrame({"trial_id": pdf["trial_id"], "y_pred": model.predict(pdf[["x0", "x1"]].to_numpy())})

    return df.mapInPandas(tell, "trial_id long, y_pred long")


@query()
def bootstrap_mean(spark, d):
    return rank.distributed_bootstrap(table(spark, d, "events"), "value", 200).select(r("estimate", 4).alias("estimate"), (F.col("lower") < F.col("upper")).alias("ordered"))


@query()
def permuted_labels(spark, d):
    return splits.permute_labels(T.embedding_trials(spark, d), 3).select("trial_id", "subject", "label")


@query()
def synthetic_trials(spark, d):
    t = T.make_synthetic(spark, n_subjects=4, n_trials_per_subject=20, n_channels=8, n_times=128)
    return t.select("trial_id", "subject", "label", M.scm("signal", 8).alias("cov"))


@query()
def transfer_stages(spark, d):
    from covarium.operators import transfer

    df = covs(spark, d)
    subjects = sorted(row["subject"] for row in df.select("subject").distinct().collect())
    folds = [transfer.transfer_fold(df, k).select(F.lit(k).alias("subject"), "stage", "n", r("kappa", 6).alias("kappa")) for k in subjects]
    return reduce(DataFrame.unionByName, folds)


@query()
def mixed_model(spark, d):
    """Order prices by year and status with a random intercept for each customer's nation, REML, over group means."""
    from covarium.operators import mixed

    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy("c_nationkey", F.year("o_orderdate").alias("yr"), (F.col("o_orderstatus") == "F").cast("double").alias("done")).agg((F.avg("o_totalprice") / 1000).alias("v")).toPandas().sort_values(["c_nationkey", "yr", "done"])
    model = mixed.fit(np.c_[np.ones(len(cells)), cells["yr"] - 1995, cells["done"]], cells["v"].to_numpy(), cells["c_nationkey"].to_numpy(), names=("intercept", "year", "done"))
    return spark.createDataFrame([(x["term"], round(x["estimate"], 4), round(x["p"], 4)) for x in model.table()], "term string, estimate double, p double")


@query()
def pooled_comparison(spark, d):
    f = fold_scores(spark, d)
    a, b = (f.select("fold", F.col(c).alias("score")) for c in ("sa", "sb"))
    out = compare.compare(a, b, n_train=2304, n_test=288, bound=0.05)
    return spark.createDataFrame([(out.k, float(round(out.t, 6)), float(round(out.p, 6)), out.verdict())], "k long, t double, p double, verdict string")
