"""Networks, Gaussian processes and generators."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import neural
from tessera.sources import generators

R = np.random.default_rng(6)
X = R.uniform(-2, 2, (150, 2))
Y = np.sin(X[:, 0]) + 0.5 * X[:, 1]


def _table(spark):
    return spark.createDataFrame([(i, float(a), float(b), float(y), "in" if a * a + b * b < 2 else "out") for i, ((a, b), y) in enumerate(zip(X, Y, strict=True))], "k long, a double, b double, y double, g string").repartition(3, "k")


def _values(df, name):
    return np.array([r[0] for r in df.orderBy("k").select(name).collect()])


def test_networks(spark):
    df = _table(spark)
    got = _values(neural.MLPRegressor(["a", "b"], "y", activation="tanh", steps=60, rate=0.05).fit(df).transform(df), "prediction")
    assert ((got - Y) ** 2).mean() < 0.05 * Y.var()
    told = _values(neural.MLPClassifier(["a", "b"], "g", steps=60, rate=0.05).fit(df).transform(df), "prediction")
    assert (told == np.where((X**2).sum(1) < 2, "in", "out")).mean() > 0.9


def test_gaussian_process(spark):
    df = _table(spark)
    kernel = neural.ConstantKernel(2.0) * neural.RBFKernel(1.3) + neural.WhiteKernel(0.01)
    out = neural.GaussianProcessRegressor(["a", "b"], "y", ["k"], kernel).fit(df).transform(df)
    far = ((X[:, None] - X[None]) ** 2).sum(-1)
    k = 2 * np.exp(-far / 2 / 1.69)
    assert np.allclose(_values(out, "prediction"), k @ np.linalg.solve(k + 0.01 * np.eye(150), Y), atol=1e-6)
    assert (_values(out, "prediction_std") >= 0).all()


def test_generators(spark):
    rings = generators.make_gaussian_quantiles(spark, 3000, 2, 3)
    counts = {r["y"]: r["count"] for r in rings.groupBy("y").count().collect()}
    assert len(counts) == 3 and max(counts.values()) - min(counts.values()) < 200
    low = np.array([list(r)[1:] for r in generators.make_low_rank_matrix(spark, 60, 30, 3, 0.0).collect()])
    sizes = np.linalg.svd(low)[1]
    assert sizes[0] > 0.3 and sizes[12:].max() < 0.02
    assert (np.linalg.eigvalsh(generators.make_spd_matrix(6)) > 0).all() and (np.linalg.eigvalsh(generators.make_sparse_spd_matrix(6, 0.5)) > 0).all()
    signals, code, atoms = generators.make_sparse_coded_signal(spark, 20, 5, 8, 2)
    dense = np.zeros((20, 8))
    for r in code.collect():
        dense[r["row"], r["col"]] = r["value"]
    got = np.array([list(r)[1:] for r in signals.orderBy("id").collect()])
    assert (np.count_nonzero(dense, axis=1) == 2).all() and np.allclose(got, dense @ atoms)
    board = np.array([list(r)[1:] for r in generators.make_checkerboard(spark, (40, 10), (3, 2)).orderBy("id").collect()])
    assert len(np.unique(board[:, 1:])) == 6
    blocks = generators.make_biclusters(spark, (40, 10), 3)
    assert {v for r in blocks.drop("id", "row_cluster").collect() for v in r} == {0.0, 10.0, 55.0, 100.0}
    many = generators.make_multilabel_classification(spark, 30, 12, 4, 2, 25)
    assert many.select(F.size("labels")).distinct().count() <= 2 and all(sum(list(r)[1:13]) == 25 for r in many.collect())
