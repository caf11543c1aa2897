"""Operators beyond the queries: estimators, splits, statistics, kernels, circuits, sources, shards, configs, the runner."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.functions import linalg
from covarium.functions import matrices as M
from covarium.functions import statevector as S
from covarium.operators import align, classify, compare, kernels, means, mixed, rank, splits, transfer
from covarium.plans import config as C
from covarium.plans import runner
from covarium.sources import trials as T
from covarium.sources.shards import CorruptShardError, ShardStore, to_jsonable


def clouds(spark, n=20, dim=4, seed=0, subjects=4):
    """Two classes around two points, in several subjects."""
    rng = np.random.default_rng(seed)
    centres = linalg.random_spd(dim, rng, 2)
    rows = []
    for i in range(n * 2 * subjects):
        x = linalg.geodesic(centres[i % 2], linalg.random_spd(dim, rng, 1)[0], 0.2)
        rows.append((i, f"s{i // (2 * n)}", i % 2, x.ravel().tolist()))
    return spark.createDataFrame(rows, "trial_id long, subject string, label int, cov array<double>")


def test_means_agree(spark):
    df = clouds(spark)
    x = np.array([r.cov for r in df.where("subject = 's1'").collect()]).reshape(-1, 4, 4)
    grouped = {r.subject: np.array(r.cov) for r in means.frechet_mean(df, ["subject"]).collect()}
    assert np.allclose(grouped["s1"], linalg.mean(x)["mean"].ravel())
    whole = np.array([r.cov for r in df.collect()]).reshape(-1, 4, 4)
    assert np.allclose(means.distributed_mean(df)["mean"], linalg.mean(whole)["mean"])
    le = {r.subject: np.array(r.cov) for r in means.mean_logeuclid(df, ["subject"], n=4).collect()}
    assert np.allclose(le["s1"], linalg.mean(x, "logeuclid")["mean"].ravel())
    with pytest.raises(ValueError):
        means.group_mean(df, ["subject"], metric="stein")


def test_pairwise_matches_loop(spark):
    df = clouds(spark, 3)
    x = {r.trial_id: np.array(r.cov).reshape(4, 4) for r in df.collect()}
    got = {(r.i, r.j): r.value for r in means.pairwise_distances(df).collect()}
    assert len(got) == len(x) ** 2 and all(got[i, i] == 0 for i in x)
    assert all(np.isclose(got[i, j], linalg.distance(x[i], x[j])) for i in x for j in x if i != j)
    both = means.pairwise_distances(df.where("label = 0"), df.where("label = 1"))
    assert both.count() == (len(x) // 2) ** 2


def test_alignment(spark):
    df = clouds(spark)
    with pytest.raises(ValueError):
        align.RiemannianAlignment()
    out = align.RiemannianAlignment(assume_calibration_data=True).fit_transform(df)
    assert align.alignment_quality(out).first().max_distance < 1e-8
    with pytest.raises(KeyError):
        align.align_domains(df, align.domain_references(df.where("subject <> 's0'")))


def test_tangent_space(spark):
    df = clouds(spark)
    space = align.TangentSpace().fit(df)
    out = space.inverse_transform(space.transform(df).withColumn("old", F.col("cov")))
    assert out.select(F.max(M.euclid("cov", "old"))).first()[0] < 1e-8
    assert len(space.feature_names()) == 10


@pytest.mark.parametrize("metric", ["airm", "logeuclid", "euclid"])
def test_mdm(spark, metric):
    df = clouds(spark)
    model = classify.MDM(metric).fit(df)
    out = model.predict_proba(df)
    assert out.where("y_pred = label").count() > 0.9 * df.count()
    r = out.first()
    assert sum(r.proba) == pytest.approx(1) and (np.argmax(r.proba) == np.argmin(r.distances))
    with pytest.raises(ValueError):
        classify.MDM().fit(df.where("label = 0"))


def test_linear_models(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.standard_normal(3) + 2 * (i % 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "trial_id long, label int, features array<double>")
    assert classify.LinearDiscriminant().fit(df).predict(df).where("y_pred = label").count() > 180
    model, data = classify.logistic(df)
    assert model.transform(data).where("y_pred = label").count() > 180


def test_svm_separates():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 2))
    y = (np.linalg.norm(x, axis=1) > 1.1).astype(int) + (x[:, 0] > 1.5)
    gram = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.mean(np.array(classify.KernelSVM(10).fit(gram, y.tolist()).predict(gram)) == y) > 0.95
    coef, _ = classify.smo(gram, y > 0)
    assert abs(coef.sum()) < 1e-8 and np.abs(coef).max() <= 1 + 1e-9


def test_splits_keep_their_word(spark):
    df = clouds(spark, 6)
    rows = {r.trial_id: r.subject for r in df.collect()}
    for splitter in (splits.LeaveOneSubjectOut(), splits.WithinSubjectChronological(0.5, 3), splits.WithinSubjectKFold(4)):
        got = splitter.split(df).collect()
        for fold in range(splitter.n_splits(df)):
            train = {r.trial_id for r in got if r.fold == fold and r.role == "train"}
            test = {r.trial_id for r in got if r.fold == fold and r.role == "test"}
            assert train and test and not train & test
            if splitter.info.subject_independent:
                assert not {rows[t] for t in train} & {rows[t] for t in test}
            if splitter.info.temporally_disjoint and not splitter.info.subject_independent:
                for s in set(rows.values()):
                    assert max(t for t in train if rows[t] == s) < min(t for t in test if rows[t] == s)
    with pytest.raises(ValueError):
        splits.LeakyShuffleSplit(5, random_state=0)
    leaky = splits.make_splitter("leaky_shuffle", random_state=0, acknowledge_leakage=True)
    assert leaky.info.is_optimistic and leaky.split(df).where("role = 'test'").count() == len(rows)
    with pytest.raises(ValueError):
        splits.make_splitter("random")


def test_comparison(spark):
    a = spark.createDataFrame([(k, 0.5 + 0.01 * k) for k in range(9)], "fold int, score double")
    same = a.select("fold", (F.col("score") - 0.05).alias("score"))
    out = compare.compare(a, same, n_train=2304, n_test=288)
    assert out.t == float("inf") and out.p == 0
    assert compare.compare(a, a, n_train=2304, n_test=288, bound=0.1).verdict() == "equivalent"
    with pytest.raises(ValueError):
        compare.compare(a, a.where("fold < 5"), n_train=1, n_test=1)
    flips = compare.sign_flip_p(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "d double")).first()
    assert flips.p_value == 2 / 16 and flips.n_flips == 16
    p = spark.createDataFrame([(0.04,), (0.045,)], "p_value double")
    assert [round(r.p_holm, 3) for r in compare.holm(p).orderBy("p_value").collect()] == [0.08, 0.08]
    assert [round(r.p_hochberg, 3) for r in compare.hochberg(p).orderBy("p_value").collect()] == [0.045, 0.045]
    p = spark.createDataFrame([(0.001,), (0.012,), (0.03,), (0.2,), (0.5,)], "p_value double")
    assert [round(r.p_holm, 3) for r in compare.holm(p).orderBy("p_value").collect()][:2] == [0.005, 0.048]


def test_bootstrap():
    x = np.random.default_rng(6).standard_normal(200) + 3
    for method in ("bca", "percentile"):
        ci = rank.bootstrap_ci(x, n_resamples=2000, method=method)
        assert ci.contains(x.mean()) and ci.width == pytest.approx(2 * 1.96 / 200**0.5, rel=0.25)
    assert rank.bootstrap_ci([1.0, 1.0, 1.0], n_resamples=50).method == "percentile"
    assert rank.spearman_ci(range(20), range(20))["rho"] == pytest.approx(1)


def test_states_and_kernels(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (6, 3))
    psi = S.feature_state(x, "angle")
    assert np.allclose(S.fidelity(psi, psi), S.angle_kernel(x, x), atol=1e-12)
    for name in S.MAPS:
        psi = S.feature_state(x, name, 2)
        assert np.allclose(np.linalg.norm(psi, axis=1), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "trial_id long, features array<double>")
    psi = S.feature_state(x, "zz")
    want = S.fidelity(psi, psi)
    assert all(np.isclose(r.value, want[r.i, r.j]) for r in kernels.fidelity_gram(df, "zz").collect())
    assert kernels.effective_rank(np.eye(5)) == pytest.approx(5)
    assert kernels.select_scale(x, "angle") in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5)
    with pytest.raises(ValueError):
        S.zero(1, 21)


def test_circuit():
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (40, 2))
    y = (x[:, 0] > 0).astype(int)
    model = S.Reuploading(2, 2, seed=1)
    g, eps = model.gradient(x, 2.0 * y - 1), 1e-5
    loss = lambda p: np.mean((model.output(x, p) - (2 * y - 1)) ** 2)
    step = np.zeros_like(model.params)
    step[1, 0, 1] = eps
    assert g[1, 0, 1] == pytest.approx((loss(model.params + step) - loss(model.params - step)) / (2 * eps), abs=1e-5)
    model.fit(x, y.tolist())
    assert np.mean(np.array(model.predict(x)) == y) > 0.9
    assert np.allclose(S.noisy_output(model, x[:4], 0, 0), model.output(x[:4]))
    assert (np.abs(S.noisy_output(model, x[:4], 0.05, 0.1)) < np.abs(model.output(x[:4])) + 1e-9).all()
    assert np.mean(np.array(model.shot_predictions(x, 2000)) == y) > 0.85
    assert S.gradient_variance(2, 1, 8) >= 0


def test_trials(spark, tmp_path):
    t = T.make_synthetic(spark, n_subjects=3, n_trials_per_subject=8, n_channels=4, n_times=32, seed=1).cache()
    assert sorted(t.collect()) == sorted(T.load_dataset(spark, "synthetic", n_subjects=3, n_trials_per_subject=8, n_channels=4, n_times=32, seed=1).collect())
    s = T.summary(t)
    assert (s.n_trials, s.n_subjects, s.n_channels, s.n_times, s.chance_accuracy) == (24, 3, 4, 32, 0.5)
    for bad in (t.limit(0), t.where("label = 0"), t.withColumn("signal", F.transform("signal", lambda c: F.slice(c, 1, 3))), t.withColumn("signal", F.array(F.array(F.lit(float("nan")), F.lit(1.0))))):
        with pytest.raises(ValueError):
            T.validate(bad)
    with pytest.raises(ValueError):
        T.select_subjects(t, ["S01", "S99"])
    assert [r.trial_id for r in T.take(t, [3, 0, 3]).collect()] == [3, 0, 3]
    with pytest.raises(KeyError):
        T.load_dataset(spark, "nothing")
    calls = []
    make = lambda: calls.append(1) or t
    for _ in range(2):
        assert T.cached(spark, str(tmp_path), "x", {"channels": ["a", "b"]}, make).count() == 24
    assert len(calls) == 1 and T.cache_key({"channels": ["a", "b"]}) != T.cache_key({"channels": ["b", "a"]})


def test_shards(spark, tmp_path):
    store = ShardStore(tmp_path)
    store.write("u1", {"a": 1.5, "b": float("nan"), "n": np.int64(3)}, fold=0)
    store.write("u2", {"a": 2.5, "fold": 7}, fold=1)
    assert store.read("u1").payload == {"a": 1.5, "b": "nan", "n": 3} and "u2" in store and len(store) == 2
    assert store.pending(["u3", "u1"]) == ["u3"]
    rows = {r.unit_id: r for r in store.to_frame(spark).collect()}
    assert rows["u2"].fold == 7 and rows["u1"].fold == 0 and rows["u2"].n is None
    (tmp_path / "u2.json").write_text((tmp_path / "u2.json").read_text().replace("2.5", "3.5"))
    assert store.read("u2") is None and store.completed_units() == {"u1"}
    with pytest.raises(CorruptShardError):
        ShardStore(tmp_path, strict=True).read("u2")
    assert store.clear_corrupt() == ["u2"] and len(store) == 1
    with pytest.raises(ValueError):
        store.path_for("../x")
    with pytest.raises(TypeError):
        to_jsonable(object())


def spec(tmp_path, **changes):
    base = {
        "name": "demo",
        "dataset": {"name": "synthetic", "options": {"n_subjects": 4, "n_trials_per_subject": 12, "n_channels": 4, "n_times": 64, "task_effect": 1.5}},
        "pipeline": {"steps": [{"name": "covariances", "params": {"estimator": "oas"}}, {"name": "tangent_space"}, {"name": "lda"}]},
        "runtime": {"output_root": str(tmp_path)},
    }
    return C.ExperimentConfig(**(base | changes))


def test_config(tmp_path):
    c = spec(tmp_path)
    assert c.experiment_hash() == spec(tmp_path, name="other", description="text").experiment_hash()
    assert c.experiment_hash() != spec(tmp_path, protocol={"name": "kfold"}).experiment_hash()
    C.save_config(c, tmp_path / "c.yaml")
    assert C.load_config(tmp_path / "c.yaml") == c
    (tmp_path / "c.yaml").write_text((tmp_path / "c.yaml").read_text().replace("oas", "scm"))
    with pytest.raises(ValueError):
        C.load_config(tmp_path / "c.yaml")
    for bad in ({"pipeline": {"steps": [{"name": "covariances"}]}}, {"pipeline": {"steps": [{"name": "magic"}]}}, {"name": "a/b"}, {"protocol": {"name": "leaky_shuffle"}}, {"surprise": 1}, {"evaluation": {"metrics": ["luck"]}}):
        with pytest.raises(ValueError):
            spec(tmp_path, **bad)


def test_runner_resumes(spark, tmp_path):
    c = spec(tmp_path)
    first = runner.run_experiment(spark, c)
    assert (first.n_units, first.n_computed) == (4, 4) and first.result.mean("accuracy") > 0.5
    shards = ShardStore(first.path / "shards")
    before = {s.unit_id: json.dumps(s.payload) for s in shards.load_all()}
    shards.delete(sorted(before)[0])
    again = runner.run_experiment(spark, c)
    assert again.n_computed == 1 and again.result.scores("kappa") == pytest.approx(first.result.scores("kappa"))
    assert again.result.to_frame(spark).count() == 4 and "kappa_std" in again.result.summary()


def test_experiment_files(tmp_path):
    """A file with every key loads; what can't be run fails at load, not after a fold."""
    full = {
        "name": "full", "description": "every key",
        "dataset": {"name": "synthetic", "subjects": [1, 2], "channels": ["C3", "C4"], "tmin": 0.0, "tmax": 2.0, "low_freq": 4.0, "high_freq": 40.0, "resample": 128.0},
        "pipeline": {"steps": [{"name": "covariances", "params": {"estimator": "oas"}}, {"name": "mdm"}]},
        "protocol": {"name": "within_subject_kfold", "params": {"n_splits": 3}},
        "evaluation": {"metrics": ["accuracy", "roc_auc"], "selection_metric": "accuracy", "param_grid": {"mdm__metric": ["euclid"]}, "inner_protocol": {"name": "within_subject_chronological"}, "return_train_scores": True},
        "statistics": {"alpha": 0.01, "equivalence_bound": 0.02, "n_permutations": 0, "n_bootstrap": 0, "power": 0.9, "correct_multiple_comparisons": False},
        "runtime": {"seed": 3, "output_root": "x", "n_jobs": 2, "log_level": "DEBUG", "overwrite": True},
    }
    import yaml

    (tmp_path / "full.yaml").write_text(yaml.safe_dump(full))
    c = C.load_config(tmp_path / "full.yaml")
    assert c.dataset.selection() == {"tmin": 0.0, "tmax": 2.0, "low_freq": 4.0, "high_freq": 40.0, "resample": 128.0, "subjects": [1, 2], "channels": ["C3", "C4"]}
    assert C.DatasetConfig(name="d").tmax == 2.5 and C.StatisticsConfig().n_permutations == 0
    assert not c.protocol.is_deliberately_leaky and C.ProtocolConfig(name="kfold") == C.ProtocolConfig(name="within_subject_kfold")
    for bad in (
        {"dataset": {"name": "d", "resample": 50}}, {"dataset": {"name": "d", "low_freq": 0}}, {"statistics": {"n_bootstrap": -1}}, {"runtime": {"n_jobs": 0}}, {"runtime": {"log_level": "LOUD"}},
        {"evaluation": {"metrics": ["accuracy", "accuracy"]}}, {"evaluation": {"param_grid": {"lda__shrinkage": [0.1]}}},
        {"evaluation": {"metrics": ["roc_auc"]}, "pipeline": {"steps": [{"name": "covariances"}, {"name": "tangent_space"}, {"name": "svm"}]}},
    ):
        with pytest.raises(ValueError):
            spec(tmp_path, **bad)


def test_dataset_options_reach_the_loader(spark, tmp_path):
    from covarium.sources import trials as T

    seen = {}
    if "recording" not in T.available_datasets():
        T.register_dataset("recording")(lambda spark, **options: (seen.update(options), T.make_synthetic(spark, n_subjects=3, n_trials_per_subject=8, n_channels=3, n_times=64))[1])
    c = spec(tmp_path, dataset={"name": "recording", "subjects": [2], "tmin": 0.1, "options": {"extra": 1}})
    assert runner.load(spark, c).count() == 24
    assert seen == {"subjects": [2], "tmin": 0.1, "tmax": 2.5, "low_freq": 8.0, "high_freq": 30.0, "resample": None, "extra": 1}


def test_auc_train_scores_and_statistics(spark, tmp_path):
    c = spec(
        tmp_path, evaluation={"metrics": ["accuracy", "roc_auc"], "selection_metric": "roc_auc", "return_train_scores": True},
        dataset={"name": "synthetic", "options": {"n_subjects": 4, "n_trials_per_subject": 16, "n_channels": 3, "n_times": 32, "task_effect": 0.3}},
        pipeline={"steps": [{"name": "covariances"}, {"name": "mdm", "params": {"metric": "euclid"}}]},
        statistics={"n_permutations": 1, "equivalence_bound": 0.1, "n_bootstrap": 50},
    )
    out = runner.run_experiment(spark, c)
    folds = out.result.folds
    assert all(0 <= f["scores"]["roc_auc"] <= 1 and f["train_scores"]["accuracy"] >= 0.5 for f in folds)
    assert {"train_roc_auc", "roc_auc"} <= set(out.result.to_frame(spark).columns)
    told = json.loads((out.path / "summary.json").read_text())["statistics"]
    assert told["permutation"]["metric"] == "roc_auc" and len(told["permutation"]["null"]) == 1
    assert told["roc_auc"]["p_adjusted"] >= told["roc_auc"]["p_value"] and 0 <= told["accuracy"]["equivalence_p"] <= 1 and told["accuracy"]["detectable"] > 0


def test_auc_of_several_classes(spark):
    from covarium.operators import metrics

    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        p = rng.dirichlet([1, 1, 1]).round(2)
        rows.append((int(rng.choice(3, p=p / p.sum())), p.tolist()))
    got = metrics.roc_auc_of_probabilities(spark.createDataFrame(rows, "y_true int, proba array<double>"), classes=[0, 1, 2]).first()[0]

    def plain(k):
        a, b = [p[k] for y, p in rows if y == k], [p[k] for y, p in rows if y != k]
        return np.mean([(x > z) + 0.5 * (x == z) for x in a for z in b])

    assert got == pytest.approx(np.mean([plain(k) for k in range(3)]))


def test_leaky_blocks_are_even(spark):
    df = spark.range(103).selectExpr("id as trial_id", "id % 4 as subject")
    sizes = sorted(r["count"] for r in splits.LeakyShuffleSplit(5, random_state=1, acknowledge_leakage=True).split(df).where("role = 'test'").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_permutation(spark):
    df = clouds(spark, 4)
    out = runner.permutation_test([("mdm", {"metric": "logeuclid"})], df, splits.WithinSubjectKFold(2), n_permutations=2)
    assert out["p_value"] >= out["least_p"] == pytest.approx(1 / 3)


def test_grid_and_jobs(spark, tmp_path):
    c = spec(
        tmp_path, pipeline={"steps": [{"name": "covariances"}, {"name": "mdm", "params": {"metric": "euclid"}}]},
        evaluation={"grid": {"mdm__metric": ["euclid", "logeuclid"]}, "inner_protocol": {"name": "kfold", "params": {"n_splits": 2}}}, runtime={"output_root": str(tmp_path), "n_jobs": 2},
    )
    out = runner.run_experiment(spark, c)
    assert out.n_computed == 4 and set(out.intervals) == {"accuracy", "balanced_accuracy", "kappa"}
    assert json.loads((out.path / "summary.json").read_text())["chance_level"] > 0.5


def test_procrustes_and_transfer(spark):
    rng = np.random.default_rng(9)
    source = linalg.random_spd(3, rng, 3, 20.0)
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    q = transfer.procrustes_rotation(source, linalg.congruence(turn, source), restarts=6)
    assert (linalg.distance(source, linalg.congruence(q @ turn, source)) ** 2).sum() < 1e-3 * (linalg.distance(source, linalg.congruence(turn, source)) ** 2).sum()
    assert np.allclose(q @ q.T, np.eye(3), atol=1e-8)
    df = clouds(spark, 8, 3)
    got = {r.stage: r.accuracy for r in transfer.transfer_fold(df, "s0").collect()}
    assert set(got) == {"recentred", "stretched", "rotated"} and min(got.values()) > 0.7
    predicted = classify.MDM("euclid").fit(df).predict(df).select("trial_id", F.col("label").alias("y_true"), "y_pred")
    assert transfer.per_subject_scores(predicted, df).count() == 4
    with pytest.raises(ValueError):
        transfer.per_subject_scores(predicted.limit(3), df)


def test_mixed_model():
    rng = np.random.default_rng(10)
    g = np.repeat(np.arange(60), 10)
    x, k = rng.standard_normal(600), np.tile([0.0, 1.0], 300)
    y = 1 + 0.5 * x - 0.3 * k + 0.2 * x * k + 0.7 * rng.standard_normal(60)[g] + 0.3 * rng.standard_normal(600)
    out = mixed.fit(np.c_[np.ones(600), x, k, x * k], y, g)
    assert np.abs((out.beta - [1, 0.5, -0.3, 0.2]) / out.se).max() < 3.5
    assert out.random[0, 0] == pytest.approx(0.49, rel=0.4) and out.residual == pytest.approx(0.09, rel=0.15)
    both = mixed.interaction_model(y, x, k, g)
    assert [r["term"] for r in both.table()] == ["intercept", "predictor", "second", "interaction"] and both.table()[1]["p"] < 1e-6
    # balanced one-way layout: REML has the closed form of the analysis of variance
    y = 2 + rng.standard_normal(20)[np.repeat(np.arange(20), 5)] + 0.5 * rng.standard_normal(100)
    g = np.repeat(np.arange(20), 5)
    means_, within = y.reshape(20, 5).mean(axis=1), y.reshape(20, 5).var(axis=1, ddof=1).mean()
    one = mixed.fit(np.ones((100, 1)), y, g)
    assert one.residual == pytest.approx(within, rel=1e-3) and one.random[0, 0] == pytest.approx(means_.var(ddof=1) - within / 5, rel=1e-3)


def test_estimators_name_what_is_wrong(spark):
    df = clouds(spark, 4, 2)
    n = align.check_matrices(df)
    assert n == round(len(df.first()["cov"]) ** 0.5)
    for change, error in (
        ("array(1D, 2D, 2D, 1D)", linalg.NotPositiveDefiniteError), ("array(1D, double('nan'), 0D, 1D)", linalg.SPDError), ("array(1D, 0D, 1D)", linalg.NotSquareError), ("array(4D)", ValueError),
    ):
        first = df.first()["trial_id"]
        with pytest.raises(error) as caught:
            align.check_matrices(df.withColumn("cov", F.expr(f"if(trial_id = {first}, {change}, cov)")))
        assert str(first) in str(caught.value) or error is ValueError
    with pytest.raises(ValueError):
        align.check_matrices(df, n=n + 1)
    space = align.TangentSpace("logeuclid").fit(df)
    with pytest.raises(Exception, match="was fitted"):
        space.transform(df.withColumn("cov", F.expr("array(1D)"))).collect()
    with pytest.raises(ValueError, match="weights"):
        classify.MDM("euclid", n=n).fit(df.withColumn("w", F.lit(-1.0)), weight="w")


def test_rotation_of_any_size_keeps_its_parts():
    rng = np.random.default_rng(5)
    a = linalg.random_spd(5, rng, 4, 30.0)
    turn = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    out = linalg.rotation_split(a, linalg.congruence(turn, a))
    assert np.allclose(out[:, 1], 0, atol=1e-8) and np.allclose(out[:, 0], out[:, 2]) and np.allclose(out[:, 3], 1)
    scaled = linalg.rotation_split(a, 2 * a)
    assert np.allclose(scaled[:, 0], np.sqrt(5) * np.log(2)) and np.allclose(scaled[:, 2], 0, atol=1e-6)


def test_group_means_do_not_depend_on_partitions(spark):
    """Means of 32 amounts in cents are often a tie in the sixth digit, which the order of the sum settles."""
    rng = np.random.default_rng(3)
    rows = [(k, k % 200, float(v)) for k, v in enumerate(np.round(rng.uniform(0, 100, 6400), 2))]
    sums = {}
    for _, g, v in rows:
        sums[g] = sums.get(g, 0.0) + v
    df = spark.createDataFrame(rows, "k long, g long, value double")
    for n in (1, 7):
        got = rank.group_mean_join_back(df.repartition(n, F.hash("value")), ["g"], "value", 50, order=["k"]).collect()
        assert {r.k: r.group_mean for r in got} == {k: sums[g] / 32 for k, g, _ in rows if sums[g] / 32 > 50}


def test_fold_classifier_matches_kernel_machine(spark):
    rng = np.random.default_rng(5)
    x, subject = rng.standard_normal((150, 6)), np.arange(150) % 3
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.standard_normal(150) > 0).astype(int)
    df = spark.createDataFrame([(k, int(s), int(c), v.tolist()) for k, (s, c, v) in enumerate(zip(subject, y, x))], "trial_id long, subject long, label int, features array<double>")
    model = kernels.FoldClassifier(3, scale=0.5).fit(df)
    got = np.array([r.y_pred for r in model.predict(df).orderBy("trial_id").collect()])
    for s in range(3):
        plain = kernels.KernelClassifier(3, scale=0.5).fit(x[subject != s], y[subject != s].tolist())
        ((_, _, _, coef, bias),) = plain.svm.pairs
        sign, m = np.where(y[subject != s] == 0, 1.0, -1.0), model.fitted[s]
        f = model._simulated(m, x[subject != s])
        primal = (m.weights[:-1] ** 2).sum() / 2 + np.clip(1 - sign * (f @ m.weights), 0, None).sum()
        dual = np.abs(coef).sum() - coef @ plain.gram @ coef / 2
        assert -1e-6 < primal - dual < 2e-3 * dual
        assert (got[subject == s] == plain.predict(x[subject == s])).mean() > 0.95


def test_blocks_of_pairs_do_not_replicate_rows(spark):
    a, b = spark.range(50).withColumnRenamed("id", "i"), spark.range(30).withColumnRenamed("id", "j")
    pairs = means.blocked_pairs(a, b, "i", "j", blocks=4)
    assert sorted((r.i, r.j) for r in pairs.collect()) == [(i, j) for i in range(50) for j in range(30)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan and pairs.rdd.getNumPartitions() == 16
