"""Absorbed effects against dense dummies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobpanel.operators import absorb, econ
from jobpanel.operators.econ import covariate, fixed_effect


def _data(seed=0, n=900):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"a": rng.integers(0, 30, n), "b": rng.integers(0, 17, n), "x": rng.normal(size=n), "w": rng.integers(1, 9, n).astype(float)})
    df["x2"] = rng.normal(size=n) + df["a"] / 10 + df["b"] / 5
    df["y"] = 2.0 * df["x"] - 0.5 * df["x2"] + np.sin(df["a"]) + df["b"] * 0.3 + rng.normal(size=n) + 1000
    return df


@pytest.mark.parametrize("effects,cov,cluster", [
    (["a"], "hc1", None), (["b", "a"], "cluster", "k")])
def test_equals_the_dense_solution(spark, effects, cov, cluster):
    pdf = _data()
    df = spark.createDataFrame(pdf).withColumn("k", F.col("b") % 5)
    got = absorb.absorbed_wls(df, "y", ["x", "x2"], effects, "w", cov, cluster)
    want = econ.wls(df, "y", [*[fixed_effect(e) for e in effects], covariate("x"), covariate("x2")], "w", cov, cluster)
    assert (got.n, got.rank) == (want.n, want.rank)
    for name in ("x", "x2"):
        for key in ("beta", "se", "pval", "r2"):
            assert got[name][key] == pytest.approx(want[name][key], rel=1e-6, abs=1e-12)


def test_missing_rows_null_levels_and_explained_covariates(spark):
    pdf = _data(1, 300)
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("a") > 2, F.col("a"))).withColumn(
        "x", F.when(F.rand(3) > 0.1, F.col("x"))).withColumn("flat", F.col("b") * 2.0)
    df = spark.createDataFrame(df.toPandas().astype({"a": "Int64"}))
    got = absorb.absorbed_wls(df, "y", ["x", "flat"], ["a", "b"], "w")
    want = econ.wls(df.withColumn("a", F.coalesce(F.col("a").cast("string"), F.lit("none"))), "y", [fixed_effect("a"), fixed_effect("b"), covariate("x")], "w")
    assert got["x"]["beta"] == pytest.approx(want["x"]["beta"]) and got["x"]["se"] == pytest.approx(want["x"]["se"])
    assert got["flat"]["beta"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        absorb.absorbed_wls(df, "y", ["x"], ["a"], cov="other")


def test_fifty_thousand_levels(spark):
    df = spark.range(150_000).select(
        (F.col("id") % 50_000).alias("a"), (F.col("id") % 7).alias("b"), F.randn(1).alias("x"), F.randn(2).alias("e")).withColumn(
        "y", 3 * F.col("x") + F.sin("a") + F.col("b") + 0.1 * F.col("e"))
    got = absorb.absorbed_wls(df, "y", ["x"], ["a", "b"], tolerance=1e-5)
    assert got.extra["levels"] == {"a": 50_000, "b": 7}
    assert got["x"]["beta"] == pytest.approx(3, abs=0.004) and got.rank == 50_000 + 6 + 1


def test_tables_of_finished_rounds_are_deleted(spark):
    import os

    from jobpanel.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:").replace("//", "/")

    def held():
        return {f for f in os.listdir(folder) if f.startswith("jobpanel-")}

    before = held()
    got = absorb.absorbed_wls(spark.createDataFrame(_data(3, 200)), "y", ["x"], ["a", "b"], cov="cluster", cluster="a")
    assert got.extra["rounds"] > 2 and len(held() - before) <= 1


def test_effects_that_do_not_converge_raise(spark, monkeypatch):
    monkeypatch.setattr(absorb, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="are left"):
        absorb.absorbed_wls(spark.createDataFrame(_data(2, 200)), "y", ["x"], ["a", "b"])
