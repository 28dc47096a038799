import numpy as np
import pytest

from tessera.errors import InsufficientSamples, InvalidParameter, NotFinite, ShapeMismatch
from tessera.functions.special import beta_regularised, gamma_upper
from tessera.operators import bayes, decomposition, linear, preprocess, quantile, selection, splits
from tessera.operators.base import Pipeline
from tessera.sources import generators, svmlight
from tessera.streaming.incremental import StreamingMoments


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + r.normal(size=300) * 0.1
    rows = [(i, *map(float, x[i]), float(y[i]), int(x[i, 0] > 0)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k int").cache(), x, y


def test_least_squares_family(points):
    df, x, y = points
    design = np.column_stack([np.ones(300), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    model = linear.LinearRegression(["a", "b", "c"], "y").fit(df)
    assert np.allclose([model.intercept, *model.coefficients], want)
    centred, t = x - x.mean(0), y - y.mean()
    ridge = linear.Ridge(["a", "b", "c"], "y", alpha=5.0).fit(df)
    assert np.allclose(ridge.coefficients, np.linalg.solve(centred.T @ centred + 5 * np.eye(3), centred.T @ t))
    lasso = linear.Lasso(["a", "b", "c"], "y", alpha=0.3).fit(df)
    g = centred.T @ (t - centred @ lasso.coefficients) / 300
    for weight, slope in zip(lasso.coefficients, g, strict=True):  # optimality
        assert abs(slope - 0.3 * np.sign(weight)) < 1e-6 if weight else abs(slope) <= 0.3 + 1e-6
    bayesian = linear.BayesianRidge(["a", "b", "c"], "y").fit(df)
    assert np.allclose(bayesian.coefficients, want[1:], atol=0.02)
    assert np.allclose(linear.HuberRegressor(["a", "b", "c"], "y").fit(df).coefficients, want[1:], atol=0.05)
    assert np.allclose(linear.OrthogonalMatchingPursuit(["a", "b", "c"], "y", n_nonzero=3).fit(df).coefficients, want[1:])


def test_logistic_regression_is_stationary(points):
    df, x, _ = points
    m = linear.LogisticRegression(["b", "c"], "k", C=2.0).fit(df)
    k = (x[:, 0] > 0).astype(float)
    p = 1 / (1 + np.exp(-(m.intercept + x[:, 1:] @ m.coefficients)))
    assert np.allclose(x[:, 1:].T @ (k - p) - m.coefficients / 2, 0, atol=1e-5)


def test_components_covariance_and_clusters(points):
    df, x, _ = points
    pca = decomposition.PCA(["a", "b", "c"], 3)
    scores = np.array([list(r) for r in pca.fit_transform(df).orderBy("id").select("pc1", "pc2", "pc3").collect()])
    assert np.allclose(scores.var(axis=0, ddof=1), pca.explained_variance) and np.allclose(np.cov(scores.T), np.diag(pca.explained_variance), atol=1e-9)
    lw = decomposition.LedoitWolf(["a", "b", "c"]).fit(df)
    assert 0 <= lw.shrinkage <= 1
    squares = decomposition.EmpiricalCovariance(["a", "b", "c"]).fit(df).mahalanobis(df).agg({"mahalanobis": "avg"}).first()[0]
    assert np.isclose(squares, 3)
    blobs = generators.make_blobs(df.sparkSession, 90, 2, 3, 0.1, seed=3)
    pairs = decomposition.KMeans(["x0", "x1"], 3).fit_transform(blobs).select("y", "cluster").distinct().count()
    assert pairs == 3


def test_partial_fits_merge(points):
    df, _, _ = points
    whole = bayes.GaussianNB(["a", "b"], "k").fit(df).transform(df).orderBy("id").collect()
    parts = bayes.GaussianNB(["a", "b"], "k")
    parts.partial_fit(df.where("id < 100"))
    merged = parts.partial_fit(df.where("id >= 100")).transform(df).orderBy("id").collect()
    assert [r["prediction"] for r in whole] == [r["prediction"] for r in merged]


def test_power_transformer_finds_the_likeliest_power(spark):
    x = np.random.default_rng(3).gamma(2.0, 2.0, 400) - 1
    fitted = quantile.PowerTransformer(["v"])
    out = np.array([r[0] for r in fitted.fit_transform(spark.createDataFrame([(float(v),) for v in x], "v double")).collect()])
    assert np.isclose(out.mean(), 0, atol=1e-9) and np.isclose(out.std(), 1)

    def likelihood(p):
        y = np.where(x >= 0, ((x + 1) ** p - 1) / p, -((1 - x) ** (2 - p) - 1) / (2 - p))
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    best = max(np.arange(-2.995, 5, 0.01), key=likelihood)
    assert abs(fitted.powers["v"] - best) < 0.01


def test_errors(spark):
    df = spark.createDataFrame([(1.0, float("inf"))], "a double, b double")
    with pytest.raises(NotFinite):
        preprocess.StandardScaler(["b"]).fit(df)
    with pytest.raises(ShapeMismatch):
        preprocess.StandardScaler(["z"]).fit(df)
    with pytest.raises(InsufficientSamples):
        preprocess.MinMaxScaler(["a"]).fit(df.where("false"))
    with pytest.raises(InvalidParameter):
        preprocess.Normalizer(["a"], "l3")
    model = preprocess.OrdinalEncoder(["a"]).fit(df)
    with pytest.raises(Exception, match="unknown category"):
        model.transform(spark.createDataFrame([(2.0, 0.0)], "a double, b double")).collect()


def test_missing_values_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("nan"), 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    out = Pipeline(preprocess.SimpleImputer(["a"]), preprocess.StandardScaler(["a", "b"])).fit(df).transform(df).collect()
    assert [r["b"] for r in out] == [0.0] * 4
    assert [round(r["a"], 6) for r in out] == [-1.414214, 0.0, 1.414214, 0.0]


def test_folds(spark):
    df = spark.range(23).selectExpr("id", "cast(id % 3 as int) as k", "cast(id % 5 as int) as g")
    folds = {r["id"]: r["fold"] for r in splits.k_fold(df, ["id"], 4).collect()}
    assert [folds[i] for i in range(23)] == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 5
    by = splits.stratified_k_fold(df, ["id"], "k", 4).groupBy("k", "fold").count().collect()
    assert max(r["count"] for r in by) - min(r["count"] for r in by) <= 1
    assert splits.group_k_fold(df, "g", 3).groupBy("g").agg({"fold": "max"}).count() == 5
    assert splits.train_test_split(df, ["id"], 0.3).where("part = 'test'").count() == 7


def test_special_functions():
    assert np.isclose(beta_regularised(2, 3, 0.4), 0.5248) and np.isclose(gamma_upper(1.5, 2.0), 0.2614641, atol=1e-6)
    assert np.isclose(beta_regularised(0.5, 0.5, 0.5), 0.5) and gamma_upper(2, 0) == 1


def test_selectors(points):
    df, _, _ = points
    for mode, param in (("fpr", 0.01), ("fwe", 0.01), ("fdr", 0.01)):
        chosen = selection.Selector(["a", "b", "c"], "k", mode, param)
        chosen.fit(df)
        assert chosen.kept == ["a"]


def test_generators_and_files(spark, tmp_path):
    for make in (generators.make_moons, generators.make_circles, generators.make_swiss_roll, generators.make_s_curve, generators.make_friedman1, generators.make_friedman2, generators.make_friedman3, generators.make_hastie_10_2, generators.make_sparse_uncorrelated, generators.make_classification):
        a, b = make(spark, 50, seed=4), make(spark, 50, seed=4).repartition(3)
        assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 50
    df, w = generators.make_regression(spark, 80, 3, 2, seed=1)
    assert np.allclose(linear.LinearRegression(["x0", "x1", "x2"], "y").fit(df).coefficients, w, atol=1e-6)
    svmlight.dump_svmlight(df, ["x0", "x1", "x2"], "y", str(tmp_path / "s"))
    assert svmlight.load_svmlight(spark, str(tmp_path / "s")).count() == 80
    (tmp_path / "f" / "one").mkdir(parents=True)
    (tmp_path / "f" / "one" / "x.txt").write_text("hello")
    assert [(r["label"], r["text"]) for r in svmlight.load_files(spark, str(tmp_path / "f")).collect()] == [(0, "hello")]


def test_streaming_moments_count_each_batch_once(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double")
    df.write.parquet(str(tmp_path / "in"))
    moments = StreamingMoments(["v"], str(tmp_path / "state"))
    query = moments.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"))
    query.awaitTermination()
    moments.update(df, 7)
    moments.update(df, 7)
    row = moments.result(spark).first()
    assert row["n"] == 6 and np.isclose(row["mean"], 3) and np.isclose(row["var"], np.var([1, 2, 6]))
