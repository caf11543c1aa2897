"""Every core query that has an oracle against DuckDB on the smallest tables; the rest by their properties."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__
from covarium.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, duck, name):
    got, want = ordered(core.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(core.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind in "fi":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(core.ORACLES) <= set(core.QUERIES) <= set(__spark_entry__.queries())


def test_without_oracles(spark):
    run = lambda n: core.QUERIES[n](spark, SF)
    assert all(r.converged for r in run("frechet_mean").collect()) and run("frechet_mean_distributed").first().converged
    assert all(r.returns and r.share == 0.5 for r in run("geodesic_transport").collect())
    stages = {r.stage: r.max_distance for r in run("aligned_quality").collect()}
    assert stages["aligned"] < 1e-8 < stages["raw"]
    assert all(r.scm >= max(r.ledoit_wolf, r.oas) - 1e-9 for r in run("shrinkage_covariances").collect())
    for name in ("zz_fidelity_gram", "iqp_fidelity_gram"):
        rows = run(name).collect()
        assert all(-1e-9 <= r.value <= 1 + 1e-9 and (r.i != r.j or abs(r.value - 1) < 1e-9) for r in rows)
    before = core.T.embedding_trials(spark, SF).groupBy("subject", "label").count().collect()
    assert sorted(before) == sorted(run("permuted_labels").groupBy("subject", "label").count().collect())
    assert run("bootstrap_mean").first().ordered and run("pooled_comparison").first().k > 4


def test_transfer_of_every_subject(spark):
    rows = __spark_entry__.queries()["transfer_stages"](spark, "/root/testdata/sf0.001").collect()
    stages = {r.stage for r in rows}
    assert len({r.subject for r in rows}) == 5 and len(rows) == 5 * len(stages)


def test_kernel_classifier_takes_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr("covarium.plans.runner.DENSE_ROWS", 50)
    rows = core.QUERIES["kernel_classifier"](spark, SF).collect()
    assert len({r.trial_id for r in rows}) == len(rows) == core.table(spark, SF, "embeddings").count() > 50


def test_reuploading_circuit_takes_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr("covarium.plans.runner.DENSE_ROWS", 50)
    got = {r.trial_id: r.y_pred for r in core.QUERIES["reuploading_circuit"](spark, SF).collect()}
    rows = core.features(spark, SF).orderBy("trial_id").collect()
    x = np.array([r.features[:2] for r in rows]) * 3
    model = core.S.Reuploading(2, 2, epochs=3, batch=64).fit(x, [r.label for r in rows])
    assert got == dict(zip([r.trial_id for r in rows], model.predict(x)))
