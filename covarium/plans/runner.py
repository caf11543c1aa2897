"""The experiment runner: config to folds to shards to result, resumable; and in-memory evaluation."""

from __future__ import annotations

import platform
import subprocess
import time
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.functions import matrices as M
from covarium.functions.distributions import chance_level
from covarium.operators import metrics
from covarium.operators.align import RiemannianAlignment, TangentSpace
from covarium.operators.classify import MDM, KernelSVM, LinearDiscriminant, logistic
from covarium.operators.kernels import KernelClassifier
from covarium.operators.rank import bootstrap_ci
from covarium.operators.splits import SPLITTERS, BaseSplitter, make_splitter
from covarium.plans.config import ExperimentConfig, save_config
from covarium.sources import trials as T
from covarium.sources.shards import ShardStore, canonical


#: Rows of a fold that a kernel machine takes; their Gram matrix has the square of that many entries.
DENSE_ROWS = 10_000


class FoldModel:
    """A pipeline's steps behind the covariances, fitted on training rows only."""

    def __init__(self, steps: list[tuple[str, dict]]) -> None:
        self.steps = steps

    def fit_predict(self, train: DataFrame, *tests: DataFrame) -> list[DataFrame]:
        """``trial_id, y_true, y_pred`` of the rows of each of ``tests``, and ``proba`` in class order where the classifier has it."""
        for name, params in self.steps:
            if name == "tangent_space":
                space = TangentSpace(**params).fit(train)
                train, *tests = map(space.transform, (train, *tests))
            elif name in ("mdm", "lda"):
                fitted = {"mdm": MDM, "lda": LinearDiscriminant}[name](**params).fit(train)
                out = [fitted.predict_proba(t) for t in tests]
            elif name == "logistic_regression":
                from pyspark.ml.functions import array_to_vector, vector_to_array

                model, _ = logistic(train, **params)
                kind = train.schema["label"].dataType
                out = [model.transform(t.withColumn("raw_vector", array_to_vector("features"))).withColumn("y_pred", F.col("y_pred").cast(kind)).withColumn("proba", vector_to_array("probability")) for t in tests]
            elif name in ("svm", "kernel_classifier"):
                out = [self._dense(name, params, train, t) for t in tests]
            elif name == "scaler":
                stats = [(F.avg(F.get("features", F.lit(i))), F.stddev_pop(F.get("features", F.lit(i)))) for i in range(len(train.select("features").first()[0]))]
                row = train.agg(*(x.alias(f"{k}{i}") for i, pair in enumerate(stats) for k, x in zip("ms", pair))).first()
                scaled = F.array(*((F.get("features", F.lit(i)) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0) for i in range(len(stats))))
                train, *tests = (t.withColumn("features", scaled) for t in (train, *tests))
        return [t.select("trial_id", F.col("label").alias("y_true"), "y_pred", *(["proba"] if "proba" in t.columns else [])) for t in out]

    @staticmethod
    def _dense(name: str, params: dict, train: DataFrame, test: DataFrame) -> DataFrame:
        """Kernel machines need a training fold in memory: the dual is solved on the driver, for at most ``DENSE_ROWS`` rows."""
        if max(train.count(), test.count()) > DENSE_ROWS:
            raise ValueError(f"a kernel machine takes at most {DENSE_ROWS} rows in a fold; lda and logistic_regression take any number")
        a = train.select("features", "label").toPandas()
        b = test.select("trial_id", "features", "label").toPandas()
        x, z = np.stack(a["features"]), np.stack(b["features"])
        if name == "kernel_classifier":
            guess = KernelClassifier(**params).fit(x, a["label"].tolist()).predict(z)
        else:
            gamma = params.get("gamma") or 1 / (x.shape[1] * x.var())
            rbf = lambda p, q: np.exp(-gamma * ((p[:, None] - q[None]) ** 2).sum(-1))
            guess = KernelSVM(params.get("C", 1.0)).fit(rbf(x, x), a["label"].tolist()).predict(rbf(z, x))
        kind = test.schema["label"].dataType.simpleString()
        rows = [(int(t), int(y), int(g)) for t, y, g in zip(b["trial_id"], b["label"], guess)]
        return test.sparkSession.createDataFrame(rows, f"trial_id long, label {kind}, y_pred {kind}")


@dataclass
class EvaluationResult:
    folds: list[dict]
    info: dict
    chance_accuracy: float
    balance: dict = field(default_factory=dict)

    def scores(self, metric: str, train: bool = False) -> list[float]:
        return [f["train_scores" if train else "scores"][metric] for f in self.folds]

    def mean(self, metric: str) -> float:
        return float(np.mean(self.scores(metric)))

    def std(self, metric: str) -> float:
        return float(np.std(self.scores(metric), ddof=1)) if len(self.folds) > 1 else 0.0

    def fold_sizes(self) -> list[tuple[int, int]]:
        return [(f["n_train"], f["n_test"]) for f in self.folds]

    def summary(self) -> dict:
        names = self.folds[0]["scores"] if self.folds else {}
        return self.info | {"chance_accuracy": self.chance_accuracy} | {f"{m}_{k}": getattr(self, k)(m) for m in names for k in ("mean", "std")}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        named = [f["scores"] | {f"train_{k}": v for k, v in (f.get("train_scores") or {}).items()} for f in self.folds]
        return spark.createDataFrame([{"fold": f["fold"], "n_train": f["n_train"], "n_test": f["n_test"]} | {k: float(v) for k, v in some.items()} for f, some in zip(self.folds, named)])

    def __repr__(self) -> str:
        means = ", ".join(f"{m} {self.mean(m):.3f}" for m in (self.folds[0]["scores"] if self.folds else {}))
        return f"EvaluationResult({self.info.get('protocol')}, {len(self.folds)} folds: {means})"


def score(predicted: DataFrame, names: Sequence[str], classes: Sequence) -> dict[str, float]:
    """The named metrics of ``y_true, y_pred`` and, for ``roc_auc``, ``proba``."""
    row = metrics.scores(predicted).first().asDict()
    if "roc_auc" in names:
        if "proba" not in predicted.columns:
            raise ValueError("roc_auc needs a classifier with probabilities")
        row |= metrics.roc_auc_of_probabilities(predicted, classes=classes).first().asDict()
    return {m: float(row[m]) for m in names}


def evaluate_fold(model: FoldModel, data: DataFrame, folds: DataFrame, fold: int, names: tuple[str, ...], search: tuple | None = None, train_scores: bool = False) -> dict:
    """Fit on a fold's training rows and score its test rows, and with ``train_scores`` its training rows; both need two classes.

    ``search`` is (grid, inner splitter, metric): the best values on inner folds
    of the training rows are taken first.
    """
    own = folds.where(F.col("fold") == fold)
    train = data.join(own.where("role = 'train'").select("trial_id"), "trial_id", "left_semi")
    test = data.join(own.where("role = 'test'").select("trial_id"), "trial_id", "left_semi")
    sizes, classes = [], []
    for part, role in ((train, "train"), (test, "test")):
        counts = part.groupBy("label").count().collect()  # a row for each class
        if len(counts) < 2:
            raise ValueError(f"fold {fold}: the {role} rows have one class")
        sizes.append(sum(r["count"] for r in counts))
        classes.append(sorted(r["label"] for r in counts))
    began = time.time()
    best = None
    if search:
        model, best = FoldModel(chosen := select_steps(model.steps, search[0], train, *search[1:])), {}
        for key in search[0]:
            step, parameter = key.split("__", 1)
            best[key] = dict(chosen)[step].get(parameter)
    predicted = model.fit_predict(train, test, *([train] if train_scores else []))
    fitted = time.time()
    groups = [r[0] for r in test.select("subject").distinct().orderBy("subject").collect()]
    out = {"fold": fold, "n_train": sizes[0], "n_test": sizes[1], "test_groups": groups, "scores": score(predicted[0], names, classes[0])}
    if train_scores:
        out["train_scores"] = score(predicted[1], names, classes[0])
    if best is not None:
        out["best_params"] = best
    return out | {"seconds": time.time() - began, "fit_seconds": fitted - began, "score_seconds": time.time() - fitted}


def select_steps(steps: list[tuple[str, dict]], grid: dict[str, list], train: DataFrame, inner: BaseSplitter, metric: str) -> list[tuple[str, dict]]:
    """The steps with the values of a grid (``step__parameter``) that score best on inner folds of training rows; the first of equals."""
    best, top = steps, -np.inf
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        tried = [(name, params | {k.split("__", 1)[1]: v for k, v in setting.items() if k.split("__", 1)[0] == name}) for name, params in steps]
        score = evaluate(tried, train, inner, (metric,)).mean(metric)
        if score > top:
            best, top = tried, score
    return best


def evaluate(steps: list[tuple[str, dict]], data: DataFrame, splitter: BaseSplitter, names: tuple[str, ...] = ("accuracy", "balanced_accuracy", "kappa"), train_scores: bool = False) -> EvaluationResult:
    """Score steps over all folds of ``data`` (trial_id, subject, label, cov)."""
    if not names or not set(names) <= set(metrics.METRICS):
        raise ValueError(f"metrics are of {', '.join(metrics.METRICS)}")
    folds = splitter.split(data).persist()
    balance = {r["label"]: r["proportion"] for r in metrics.class_balance(data).collect()}
    try:
        out = [evaluate_fold(FoldModel(steps), data, folds, k, names, train_scores=train_scores) for k in range(splitter.n_splits(data))]
    finally:
        folds.unpersist()
    info = {"protocol": splitter.info.name, "subject_independent": splitter.info.subject_independent, "temporally_disjoint": splitter.info.temporally_disjoint}
    return EvaluationResult(out, info, max(balance.values()), balance)


def permutation_test(steps, data: DataFrame, splitter: BaseSplitter, metric: str = "balanced_accuracy", n_permutations: int = 100, seed: int = 0) -> dict:
    """p = (1 + runs under shuffled labels that reach the observed score) / (1 + runs); runs whose folds lack a class don't count."""
    from covarium.operators.splits import permute_labels

    seen = evaluate(steps, data, splitter, (metric,)).mean(metric)
    null = []
    for k in range(n_permutations):
        try:
            null.append(evaluate(steps, permute_labels(data, seed + k), splitter, (metric,)).mean(metric))
        except ValueError as error:
            if "one class" not in str(error):
                raise
    p, least = (1 + sum(x >= seen for x in null)) / (1 + len(null)), 1 / (1 + len(null))
    return {"observed": seen, "null": null, "p_value": p, "least_p": least, "at_resolution_limit": p <= least, "excess": seen - float(np.mean(null)) if null else None}


@dataclass(frozen=True)
class RunSummary:
    result: EvaluationResult
    n_units: int
    n_computed: int
    path: Path
    intervals: dict = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)

    def describe(self) -> str:
        return f"{self.n_computed} of {self.n_units} folds computed, results in {self.path}"


def collect_provenance(spark: SparkSession, config: ExperimentConfig) -> dict:
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "seed": config.runtime.seed, "commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}


def load(spark: SparkSession, config: ExperimentConfig) -> DataFrame:
    """The dataset that a specification names: recordings get its window, band, rate, subjects and channels, generated trials the seed."""
    wanted = {"seed": config.runtime.seed} if config.dataset.name == "synthetic" else config.dataset.selection()
    data = T.load_dataset(spark, config.dataset.name, **wanted | config.dataset.options)
    T.validate(data)
    if config.dataset.name == "synthetic" and config.dataset.subjects:
        data = T.select_subjects(data, list(config.dataset.subjects))
    return data


def inference(config: ExperimentConfig, result: EvaluationResult, steps: list[tuple[str, dict]], data: DataFrame, splitter: BaseSplitter) -> dict:
    """What the statistics block asks for.

    For each metric an interval of the mean over folds; the metric's corrected test
    against its chance level, adjusted over the metrics, with the least effect that
    the folds can show and, with a bound, the test of equivalence to chance; and
    the permutation test of the selection metric.
    """
    from covarium.operators import compare
    from covarium.functions.distributions import t_ppf, t_sf

    asked, folds = config.statistics, len(result.folds)
    out: dict = {}
    names = list(config.evaluation.metrics)
    if folds > 1:
        train, test = (float(np.mean(x)) for x in zip(*result.fold_sizes()))
        for m in names:
            chance = {"accuracy": result.chance_accuracy, "kappa": 0.0, "roc_auc": 0.5}.get(m, 1 / max(2, len(result.balance)))
            over = np.array(result.scores(m)) - chance
            se = (compare.correction_factor(train, test, folds)) ** 0.5 * float(over.std(ddof=1))
            mean = float(over.mean())
            p = 2 * t_sf(abs(mean) / se, folds - 1) if se > 1e-12 else float(abs(mean) <= 1e-12)
            out[m] = {"over_chance": mean, "se": se, "p_value": p, "detectable": (t_ppf(1 - asked.alpha / 2, folds - 1) + t_ppf(asked.power, folds - 1)) * se}
            if asked.equivalence_bound is not None:
                out[m]["equivalence_p"] = compare.tost_p(mean, se if se > 1e-12 else 0.0, folds - 1, asked.equivalence_bound)
            if asked.n_bootstrap:
                out[m]["interval"] = vars(bootstrap_ci(result.scores(m), n_resamples=asked.n_bootstrap, confidence=1 - asked.alpha, seed=config.runtime.seed))
        top = 0.0
        for k, m in enumerate(sorted(names, key=lambda m: out[m]["p_value"])):  # Holm's steps down
            top = max(top, min(1.0, out[m]["p_value"] * (len(names) - k)))
            out[m]["p_adjusted"] = top if asked.correct_multiple_comparisons else out[m]["p_value"]
    if asked.n_permutations:
        metric = config.evaluation.selection_metric if config.evaluation.selection_metric in names else names[0]
        out["permutation"] = permutation_test(steps, data, splitter, metric, asked.n_permutations, config.runtime.seed) | {"metric": metric}
    return out


def run_experiment(spark: SparkSession, config: ExperimentConfig, data: DataFrame | None = None) -> RunSummary:
    """Run what of an experiment isn't done yet: a shard for each fold, then the result from the shards alone.

    Covariances and the declared alignment are row- or domain-wise and applied once
    for all folds; everything else is fitted inside a fold.
    """
    if data is None:
        data = load(spark, config)
    steps = [(s.name, dict(s.params)) for s in config.pipeline.steps]
    if steps[0][0] == "covariances":
        params = steps.pop(0)[1]
        shrinkage = params.pop("shrinkage", None)
        data = data.withColumn("cov", M.covariance("signal", **params)).drop("signal")
        if shrinkage is not None:
            n = round(len(data.select("cov").first()[0]) ** 0.5)
            data = data.withColumn("cov", M.shrink("cov", n, shrinkage))
    if steps and steps[0][0] == "alignment":
        data = RiemannianAlignment(**steps.pop(0)[1]).fit_transform(data)
    if any(name in ("covariances", "alignment") for name, _ in steps):
        raise ValueError("covariances come first, then one alignment at most")
    path = config.output_dir()
    store = ShardStore(path / "shards")
    save_config(config, path / "config.yaml")
    splitter = make_splitter(config.protocol.name, **config.protocol.params)
    data = data.persist()
    try:
        units = {config.unit_id(fold=k): k for k in range(splitter.n_splits(data))}
        todo = list(units) if config.runtime.overwrite else store.pending(list(units))
        folds = splitter.split(data).persist()
        chosen = config.evaluation
        search = (chosen.param_grid, make_splitter(chosen.inner_protocol.name, **chosen.inner_protocol.params), chosen.selection_metric) if chosen.param_grid else None
        provenance = collect_provenance(spark, config)

        def work(unit: str) -> None:
            store.write(unit, evaluate_fold(FoldModel(steps), data, folds, units[unit], chosen.metrics, search, chosen.return_train_scores), fold=units[unit], provenance=provenance)

        with ThreadPoolExecutor(max(1, config.runtime.n_jobs)) as pool:
            list(pool.map(work, todo))
        folds.unpersist()
        balance = {str(r["label"]): r["proportion"] for r in metrics.class_balance(data).collect()}
        shards = {s.unit_id: s.payload for s in store.load_all()}
        if missing := [u for u in units if u not in shards]:
            raise RuntimeError(f"shards are missing: {missing}")
        done = sorted((shards[u] for u in units), key=lambda f: f["fold"])
        info = {"protocol": splitter.info.name, "subject_independent": splitter.info.subject_independent, "temporally_disjoint": splitter.info.temporally_disjoint}
        result = EvaluationResult(done, info, max(balance.values()), balance)
        told = inference(config, result, steps, data, splitter)
    finally:
        data.unpersist()
    intervals = {m: told[m]["interval"] for m in chosen.metrics if "interval" in told.get(m, {})}
    chance = chance_level(sum(n for _, n in result.fold_sizes()), max(2, len(balance)), config.statistics.alpha)
    (path / "summary.json").write_text(canonical(result.summary() | {"intervals": intervals, "statistics": told, "chance_level": chance}))
    return RunSummary(result, len(units), len(todo), path, intervals, told)


__all__ = ["SPLITTERS", "EvaluationResult", "FoldModel", "RunSummary", "evaluate", "evaluate_fold", "permutation_test", "run_experiment"]
