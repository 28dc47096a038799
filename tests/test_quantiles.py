"""Quantiles of large columns: no task holds all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear, metrics, preprocess, ranks
from tessera.operators.base import quantiles

AT = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def columns(spark):
    r = np.random.default_rng(3)
    n = 30_000
    x = {"wide": r.lognormal(0, 8, n) * r.choice([-1, 1], n), "ties": r.integers(0, 4, n).astype(float), "ends": np.where(r.random(n) < 0.3, np.inf, r.random(n))}
    rows = [(*[float(v) for v in row], None) for row in zip(*x.values(), strict=True)] + [(None,) * 4] * 7
    return x, spark.createDataFrame(rows, "wide double, ties double, ends double, none double").repartition(3).cache()


def test_quantiles_between_the_bounds_of_a_sketch(columns):
    x, df = columns
    got = ranks.exact_quantiles(df, [F.col(c) for c in df.columns], AT, whole=1000)
    for c, q in zip(x, got, strict=False):
        with np.errstate(invalid="ignore"):  # numpy has no number between two infinite ones
            want = np.where(np.isfinite(np.quantile(x[c], AT, method="lower")), np.quantile(x[c], AT), np.inf)
        assert np.allclose(q, want, rtol=1e-12)
    assert got[3] == [None] * len(AT)


def test_bounds_that_miss_are_made_wider(columns):
    x, df = columns
    for near in ((-3.0, -2.0), (0.0, 0.1), (100.0, 101.0), (1.0, 2.0), (0.5, 3.5)):
        assert ranks.exact_quantiles(df, [F.col("ties")], [0.5], near, whole=1000) == [[float(np.quantile(x["ties"], 0.5))]]


def test_no_values(spark):
    df = spark.createDataFrame([], "a double")
    assert ranks.exact_quantiles(df, [F.col("a")], [0.5], (0.0, 1.0)) == [[None]]
    assert metrics.regression_metric(spark.createDataFrame([], "y double, p double"), "median_absolute_error", "y", "p").first()[0] is None
    assert metrics.d2_score(spark.createDataFrame([], "y double, p double"), "y", "p").first()[0] is None


def test_nothing_puts_all_values_in_one_aggregate(columns, monkeypatch):
    def held(*args):
        raise AssertionError("percentile holds every distinct value in one task")

    monkeypatch.setattr(F, "percentile", held)
    x, df = columns
    finite = df.withColumn("y", F.col("ties") * 2 + F.col("ends") / (F.col("ends") + 1)).where("ends < 2")
    assert quantiles(df, ["ties"], [0.5])["ties"] == [float(np.quantile(x["ties"], 0.5))]
    preprocess.RobustScaler(["ties"]).fit(df)
    preprocess.KBinsDiscretizer(["wide"], 4, "quantile").fit(df)
    assert metrics.regression_metric(finite, "median_absolute_error", "y", "ties").first()[0] > 0
    assert metrics.d2_score(finite, "y", "ties", "pinball", 0.2).first()[0] is not None
    assert abs(linear.HuberRegressor(["ties"], "y").fit(finite).coefficients[0] - 2) < 0.05
