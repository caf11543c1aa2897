"""Per-domain alignment: references, re-centring, and how far domains lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.functions import linalg
from covarium.functions import matrices as M
from covarium.operators import means


def domain_references(df: DataFrame, domain: str = "subject", matrix: str = "cov", metric: str = "airm", n: int | None = None, **options) -> DataFrame:
    """``(domain, reference)``: the mean of each domain."""
    return means.group_mean(df, [domain], matrix, metric, n, **options).withColumnRenamed(matrix, "reference")


def check_matrices(df: DataFrame, matrix: str = "cov", key: str = "trial_id", n: int | None = None) -> int:
    """The order of all matrices, in one aggregate; what is not a table of finite symmetric positive-definite ones of one order is an error.

    It names up to five rows at fault by ``key`` and says what a singular matrix
    commonly comes from.
    """
    side = F.sqrt(F.size(matrix)).cast("int")
    wrong = F.col(matrix).isNull() | F.exists(matrix, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    shape = df.agg(F.count(F.lit(1)).alias("rows"), F.min(side).alias("least"), F.max(side).alias("most"), F.count_if(F.size(matrix) != side * side).alias("odd"), F.count_if(wrong).alias("wrong")).first()
    named = lambda where: [r[0] for r in df.where(where).select(key).limit(5).collect()]
    if not shape["rows"]:
        raise ValueError("there are no matrices")
    if shape["wrong"]:
        raise linalg.SPDError(f"{shape['wrong']} matrices with missing or infinite entries, as of {key} {named(wrong)}")
    if shape["odd"]:
        raise linalg.NotSquareError(f"{shape['odd']} matrices that are not square, as of {key} {named(F.size(matrix) != side * side)}")
    if shape["least"] != shape["most"]:
        raise ValueError(f"matrices of {shape['least']} to {shape['most']} channels in one table")
    if n is not None and shape["least"] != n:
        raise ValueError(f"matrices of {shape['least']} channels where {n} were fitted")
    if bad := named(~M.is_spd(matrix)):
        raise linalg.NotPositiveDefiniteError(f"matrices that are not positive definite, as of {key} {bad}: too few samples for the channels, a common reference, or a dead channel; shrinkage mends the first")
    return shape["least"]


def check_domains(df: DataFrame, references: DataFrame, domain: str) -> None:
    missing = df.select(domain).distinct().join(references.select(domain), domain, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no reference for {[r[0] for r in missing]}")


def align_domains(df: DataFrame, references: DataFrame | None = None, domain: str = "subject", matrix: str = "cov", metric: str = "airm", n: int | None = None) -> DataFrame:
    """Re-centre each matrix by its domain's reference: R^-1/2 C R^-1/2 whatever the metric of the mean.

    The root is taken once for each domain; the reference table joins by domain,
    broadcast by Spark where its size allows.
    """
    given = references is not None
    references = references if given else domain_references(df, domain, matrix, metric, n)
    if given:
        check_domains(df, references, domain)
    return df.join(references, domain).withColumn(matrix, M.whiten("reference", matrix)).drop("reference")


def alignment_quality(df: DataFrame, domain: str = "subject", matrix: str = "cov", metric: str = "airm", n: int | None = None) -> DataFrame:
    """``(n_domains, max_distance, mean_distance)`` of the domains' means from the identity."""
    refs = domain_references(df, domain, matrix, metric, n)
    size = F.size("reference")
    side = F.sqrt(size).cast("int")
    identity = F.transform("reference", lambda x, i: F.when(i % (side + 1) == 0, 1.0).otherwise(0.0))
    d = refs.select(M.distance(identity, "reference", metric, n).alias("d"))
    return d.agg(F.count("d").alias("n_domains"), F.max("d").alias("max_distance"), F.avg("d").alias("mean_distance"))


def _of_size(matrix: str, size: int):
    """The matrix column; another number of entries than was fitted is an error when it is read."""
    message = F.concat(F.lit(f"a matrix of {size} entries was fitted, not of "), F.size(matrix).cast("string"))
    return F.when(F.size(matrix) == size, F.col(matrix)).otherwise(F.raise_error(message))


class RiemannianAlignment:
    """Estimator: a reference for each domain. That the test domain's unlabelled data is used must be declared."""

    def __init__(self, metric: str = "airm", *, assume_calibration_data: bool = False, n: int | None = None, tol: float = 1e-10, max_iter: int = 100) -> None:
        if assume_calibration_data is not True:
            raise ValueError("alignment uses the target domain's own data; declare it with assume_calibration_data=True")
        if metric not in ("airm", "logeuclid", "euclid") or tol <= 0 or max_iter < 1:
            raise ValueError("metric is airm, logeuclid or euclid; tol is positive; max_iter is 1 or more")
        self.metric, self.n, self.options = metric, n, {"tol": tol, "max_iter": max_iter}
        self.references: DataFrame | None = None

    def fit(self, df: DataFrame, domain: str = "subject") -> RiemannianAlignment:
        self.domain = domain
        options = self.options if self.metric == "airm" or not self.n else {}
        self.references = domain_references(df, domain, metric=self.metric, n=self.n, **options)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.references is None:
            raise ValueError("not fitted")
        sizes = self.references.select(F.size("reference").alias("n")).distinct().collect()  # one, but for faults
        if len(sizes) > 1:
            raise ValueError("domains of different numbers of channels")
        df = df.withColumn("cov", _of_size("cov", sizes[0]["n"])) if sizes else df
        return align_domains(df, self.references, self.domain)

    def fit_transform(self, df: DataFrame, domain: str = "subject") -> DataFrame:
        return self.fit(df, domain).transform(df)


class TangentSpace:
    """Estimator: tangent vectors at the mean of the rows it was fitted on."""

    def __init__(self, metric: str = "airm", tol: float = 1e-10, max_iter: int = 100) -> None:
        if metric not in ("airm", "logeuclid") or tol <= 0 or max_iter < 1:
            raise ValueError("metric is airm or logeuclid; tol is positive; max_iter is 1 or more")
        self.metric, self.options = metric, {"tol": tol, "max_iter": max_iter}
        self.reference: list[float] | None = None

    def fit(self, df: DataFrame, matrix: str = "cov") -> TangentSpace:
        self.matrix = matrix
        if self.metric == "airm":
            self.info = means.distributed_mean(df, matrix, **self.options)
            self.reference = self.info["mean"].ravel().tolist()
        else:
            n = round(len(df.select(matrix).first()[0]) ** 0.5)
            self.reference = list(means.mean_logeuclid(df, [], matrix, n).first()[0])
        return self

    def _point(self):
        if self.reference is None:
            raise ValueError("not fitted")
        return F.array(*map(F.lit, self.reference))

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        point = self._point()
        return df.withColumn(output, M.tangent(_of_size(self.matrix, len(self.reference)), point, self.metric))

    def inverse_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn(self.matrix, M.untangent(features, self._point(), self.metric))

    def feature_names(self) -> list[str]:
        i, j, _ = linalg.upper(round(len(self.reference or []) ** 0.5))
        return [f"ts_{a}_{b}" for a, b in zip(i, j)]


def inter_subject_distance(df: DataFrame, subject: str = "subject", matrix: str = "cov", metric: str = "airm", n: int | None = None, mean_metric: str | None = None) -> DataFrame:
    """Mean distance over unordered pairs of subject references."""
    refs = domain_references(df, subject, matrix, mean_metric or metric, n)
    return means.upper_pairs(refs, subject, "reference", M.distance("a", "b", metric, n)).agg(F.avg("value").alias("mean_distance"))


def subject_displacements(df: DataFrame, subject: str = "subject", matrix: str = "cov", metric: str = "airm", n: int | None = None, mean_metric: str | None = None) -> DataFrame:
    """Mean distance from each subject's reference to the others'."""
    refs = domain_references(df, subject, matrix, mean_metric or metric, n)
    pairs = means.upper_pairs(refs, subject, "reference", M.distance("a", "b", metric, n))
    both = pairs.select(F.explode(F.array(F.struct(F.col("i").alias(subject), "value"), F.struct(F.col("j").alias(subject), "value"))).alias("r")).select("r.*")
    return both.groupBy(subject).agg(F.avg("value").alias("displacement"))


def dispersion(df: DataFrame, references: DataFrame, domain: str = "subject", matrix: str = "cov", n: int | None = None) -> DataFrame:
    """Mean squared distance of a domain's matrices to its reference."""
    d = M.distance("reference", matrix, "airm", n)
    return df.join(references, domain).groupBy(domain).agg(F.avg(d * d).alias("dispersion"))


def rotation_split(a: str, b: str, n: int = 2):
    """Total, spectral and rotational distance and the rotational share of two matrix columns; native for 2 x 2."""
    if n != 2:
        parts = M.rotation_split(a, b)
        return F.struct(*(F.get(parts, F.lit(k)).alias(name) for k, name in enumerate(("total", "spectral", "rotational", "fraction"))))
    total = M.airm2(a, b)
    la, sa = M.eigen2(a)
    lb, sb = M.eigen2(b)
    spectral = F.sqrt((F.log(la) - F.log(lb)) ** 2 + (F.log(sa) - F.log(sb)) ** 2)
    rotational = F.sqrt(F.greatest(total * total - spectral * spectral, F.lit(0.0)))
    return F.struct(total.alias("total"), spectral.alias("spectral"), rotational.alias("rotational"), F.when(total > 0, rotational**2 / (total * total)).otherwise(0.0).alias("fraction"))
