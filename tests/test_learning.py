"""Operators without SQL against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import clusters, encoding, factors, graphs, model_selection, neighbors, regression, reports, validation
from tessera.operators.linear import LinearRegression, LogisticRegression, Ridge
from tessera.sources import matrices, models

R = np.random.default_rng(11)
X = R.normal(size=(120, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 1.0]])
Y = 2 * X[:, 0] - X[:, 1] + 0.5 + R.normal(size=120) * 0.1
G = (X[:, 0] + 0.3 * X[:, 2] > 0).astype(int)
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, *map(float, x), float(y), int(g), i % 4) for i, (x, y, g) in enumerate(zip(X, Y, G, strict=True))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double, g int, fold int").repartition(3, "k").cache()


def _column(df, name, key="k"):
    return np.array([r[0] for r in df.orderBy(key).select(name).collect()], float)


def test_functions():
    for x in (0.1, 0.7, 1.0, 3.3, 25.0):
        h = 1e-5
        assert math.isclose(numeric.digamma(x), (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel_tol=1e-6, abs_tol=1e-6)
    assert math.isclose(numeric.beta(2, 3), 1 / 12) and math.isclose(numeric.norm_sf(1.959963984540054), 0.025, rel_tol=1e-9)
    for law in (numeric.Normal(1, 2), numeric.Gamma(2.5, 0.7), numeric.Beta(2, 5), numeric.StudentsT(5), numeric.FDist(4, 9), numeric.ChiSquared(3)):
        for q in (0.05, 0.5, 0.9):
            x = law.ppf(q)
            assert math.isclose(law.cdf(x), q, abs_tol=1e-9)
            assert math.isclose((law.cdf(x + 1e-5) - law.cdf(x - 1e-5)) / 2e-5, law.pdf(x), rel_tol=1e-4)
    assert math.isclose(numeric.quad(lambda x: math.exp(-x * x), -6, 6)[0], math.sqrt(math.pi), rel_tol=1e-10)
    assert math.isclose(numeric.gauss_legendre_composite(math.sin, 0, math.pi), 2)
    xs = np.linspace(0, 3, 13)
    spline = numeric.CubicSpline(xs, xs**3, "not-a-knot")
    assert math.isclose(spline(1.37), 1.37**3) and math.isclose(spline(1.37, 1), 3 * 1.37**2) and math.isclose(spline(1.37, 2), 6 * 1.37)


def test_minimisers():
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    grad = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    hess = lambda x, v: np.array([[2 - 400 * (x[1] - 3 * x[0] ** 2), -400 * x[0]], [-400 * x[0], 200]]) @ v
    for found in (numeric.NewtonCG().minimise(rosen, grad, hess, [-1, 2]), numeric.TrustRegionNCG(500).minimise(rosen, grad, hess, [-1, 2]), numeric.Powell(2000).minimise(rosen, [-1, 2])):
        assert np.allclose(found, 1, atol=1e-3)
    assert math.isclose(numeric.brent_bounded(lambda x: (x - 1.3) ** 2, 0, 4)[0], 1.3, rel_tol=1e-7)
    m = np.cov(X.T)
    values, vectors = numeric.eigsh(m, 2)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(m))[::-1][:2]) and np.allclose(m @ vectors, vectors * values)


def test_lars_and_lasso_meet(df):
    xc, yc = X - X.mean(0), Y - Y.mean()
    knots, steps = regression.lars_path_gram(xc.T @ xc, xc.T @ yc)
    for alpha in (0.05, 0.3, 1.0):
        b = regression.LassoLars(COLUMNS, "y", alpha=alpha).fit(df).coefficients
        assert np.allclose(b, regression.ElasticNet(COLUMNS, "y", alpha=alpha, l1_ratio=1.0).fit(df).coefficients, atol=1e-6)
    assert np.allclose(steps[:, -1], np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-8) and (np.diff(knots) <= 1e-9).all()


def test_validated_paths_and_ridge(df):
    model = regression.LassoCV(COLUMNS, "y", ["k"], n_alphas=15).fit(df)
    assert np.allclose(model.coefficients, [2, -1, 0], atol=0.1)
    found = regression.RidgeCV(COLUMNS, "y", alphas=(0.5, 50.0))
    found.fit(df)
    for alpha, error in zip((0.5, 50.0), found.errors, strict=True):
        left = []
        for i in range(len(X)):
            keep = np.arange(len(X)) != i
            xc = X[keep] - X[keep].mean(0)
            b = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (Y[keep] - Y[keep].mean()))
            left.append(Y[i] - Y[keep].mean() - (X[i] - X[keep].mean(0)) @ b)
        assert math.isclose(error, np.mean(np.square(left)), rel_tol=0.01)


def test_glm_is_stationary(df):
    counts = df.withColumn("n", F.floor(F.exp(F.col("a") * 0.5 + 1)).cast("double"))
    model = regression.PoissonRegressor(COLUMNS, "n", alpha=0.1).fit(counts)
    n = _column(counts, "n")
    mu = np.exp(X @ model.coefficients + model.intercept)
    assert abs((n - mu).mean()) < 1e-6 and np.allclose(((n - mu)[:, None] * X).mean(0), 0.1 * model.coefficients, atol=1e-6)


def test_quantile_ransac_svr_and_sgd(df):
    q = regression.QuantileRegressor(COLUMNS, "y", quantile=0.8).fit(df)
    assert 0.77 <= (Y <= X @ q.coefficients + q.intercept + 1e-6).mean() <= 0.83
    wild = df.withColumn("y", F.when(F.col("k") % 5 == 0, F.col("y") + 50).otherwise(F.col("y")))
    assert np.allclose(regression.RANSACRegressor(COLUMNS, "y", ["k"], threshold=1.0).fit(wild).coefficients, [2, -1, 0], atol=0.1)
    assert np.allclose(regression.LinearSVR(COLUMNS, "y", C=100).fit(df).coefficients, [2, -1, 0], atol=0.1)
    assert np.allclose(regression.SGDRegressor(COLUMNS, "y", epochs=60, block=8, rate=0.3).fit(df).coefficients, [2, -1, 0], atol=0.15)
    assert np.allclose(regression.PassiveAggressiveRegressor(COLUMNS, "y", epochs=20, block=4).fit(df).coefficients, [2, -1, 0], atol=0.3)


@pytest.mark.parametrize("kind", [regression.LinearSVC, regression.SGDClassifier, regression.Perceptron, regression.PassiveAggressiveClassifier, regression.RidgeClassifier, regression.LinearDiscriminantAnalysis, regression.QuadraticDiscriminantAnalysis, regression.MultinomialLogisticRegression])
def test_linear_classifiers(df, kind):
    more = {"epochs": 40, "rate": 0.3, "block": 8} if kind is regression.SGDClassifier else {}
    model = kind(COLUMNS, "g", **more).fit(df)
    assert (_column(model.transform(df), "prediction") == G).mean() > 0.9


def test_isotonic(spark):
    r = np.random.default_rng(3)
    x, y = np.arange(60) // 2, np.arange(60) / 10 + r.normal(size=60) * 2
    model = regression.IsotonicRegression("x", "y").fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(4))
    mean = np.array([y[x == v].mean() for v in range(30)])
    want = [max(min(mean[i : j + 1].mean() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    got = [model.transform(spark.createDataFrame([(float(v),)], "x double")).first()["prediction"] for v in (0, 7, 15, 29)]
    assert np.allclose(got, [want[v] for v in (0, 7, 15, 29)])


def test_factors(df):
    c = X - X.mean(0)
    svd = factors.TruncatedSVD(COLUMNS, 2)
    svd.fit(df)
    assert np.allclose(svd.singular_values, np.linalg.svd(X)[1][:2])
    half = factors.IncrementalPCA(COLUMNS, 2)
    half.partial_fit(df.where("k < 50"))
    half.partial_fit(df.where("k >= 50"))
    assert np.allclose(half.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1][:2])
    fa = factors.FactorAnalysis(COLUMNS, 1)
    fa.fit(df)
    full = fa.loadings.T @ fa.loadings + np.diag(fa.noise)
    assert np.allclose(np.diag(full), np.diag(c.T @ c / len(c)), rtol=1e-3)
    pls = factors.PLSRegression(COLUMNS, ["y"], 3)
    assert np.allclose(pls.fit(df).models[0].coefficients, np.linalg.lstsq(c, Y - Y.mean(), rcond=None)[0], atol=1e-6)
    cca = factors.CCA(COLUMNS, ["y"], 1)
    cca.fit(df)
    score = _column(cca.scores().transform(df), "pls1")
    best = np.corrcoef(X @ np.linalg.lstsq(c, Y - Y.mean(), rcond=None)[0], Y)[0, 1]
    assert math.isclose(abs(np.corrcoef(score, Y)[0, 1]), best, rel_tol=1e-6)
    positive = df.select("k", *[F.exp(c).alias(c) for c in COLUMNS])
    nmf = factors.NMF(COLUMNS, 2, max_iter=30)
    w = np.array([r[0] for r in nmf.fit(positive).transform(positive).orderBy("k").select("nmf").collect()])
    assert (w >= 0).all() and ((np.exp(X) - w @ nmf.components) ** 2).sum() < 0.35 * (np.exp(X) ** 2).sum()
    ica = factors.FastICA(COLUMNS, 3).fit(df).transform(df)
    s = np.stack([_column(ica, f"ic{i}") for i in (1, 2, 3)])
    assert np.allclose(np.cov(s, bias=True), np.eye(3), atol=1e-6)


def test_kernels(df):
    exact = np.exp(-0.5 * ((X[:, None] - X[None]) ** 2).sum(-1))
    rows = factors.Nystroem(COLUMNS, ["k"], gamma=0.5, n_components=200).fit(df).transform(df).orderBy("k").select("features").collect()
    f = np.array([r[0] for r in rows])
    assert np.allclose(f @ f.T, exact, atol=1e-5)
    got = _column(factors.KernelRidge(COLUMNS, "y", ["k"], alpha=0.5, gamma=0.5).fit(df).transform(df), "prediction")
    assert np.allclose(got, exact @ np.linalg.solve(exact + 0.5 * np.eye(len(X)), Y), atol=1e-5)
    center = np.eye(len(X)) - 1 / len(X)
    values = np.sort(np.linalg.eigvalsh(center @ exact @ center))[::-1]
    kp = factors.KernelPCA(COLUMNS, ["k"], 2, gamma=0.5)
    kp.fit(df)
    assert np.allclose(kp.eigenvalues, values[:2])


def test_covariances(df):
    s = np.cov(X.T, bias=True)
    w, p = factors.graphical_lasso(s, 0.05)
    off = ~np.eye(3, dtype=bool)
    gap = (w - s)[off]
    assert (np.abs(gap) <= 0.05 + 1e-5).all() and np.allclose(gap[np.abs(p[off]) > 1e-8], 0.05 * np.sign(p[off])[np.abs(p[off]) > 1e-8], atol=1e-3)
    wild = df.withColumn("a", F.when(F.col("k") < 12, 100.0).otherwise(F.col("a")))
    found = factors.MinCovDet(COLUMNS).fit(wild)
    assert np.allclose(found.covariance, s, atol=0.4) and np.abs(found.location - X[12:].mean(0)).max() < 0.3
    flagged = factors.EllipticEnvelope(COLUMNS, 0.1).fit(wild).transform(wild).where("prediction = -1")
    assert {r["k"] for r in flagged.collect()} == set(range(12))


def test_clusters(spark, df):
    r = np.random.default_rng(2)
    points = np.concatenate([r.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (3, 0), (0, 3))] + [np.array([[10.0, 10.0]])])
    table = spark.createDataFrame([(i, float(a), float(b), i // 40) for i, (a, b) in enumerate(points)], "k long, p double, q double, own int").repartition(4)
    got = _column(clusters.DBSCAN("k", ["p", "q"], 0.5, 4).fit_transform(table), "cluster")
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = (dist <= 0.5).sum(1) >= 4
    want, number = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = number
                    if core[j]:
                        todo += list(np.flatnonzero((dist[j] <= 0.5) & (want < 0)))
            number += 1
    assert (got == want).all()
    for model in (clusters.GaussianMixture(["p", "q"], 3, key=["k"], output="cluster"), clusters.MiniBatchKMeans(["p", "q"], ["k"], 3, batch_size=40), clusters.BisectingKMeans(["p", "q"], 3)):
        told = _column(model.fit(table.where("own < 3")).transform(table.where("own < 3")), "cluster")
        assert all(len(set(told[40 * g : 40 * g + 40])) == 1 for g in range(3)) and len(set(told)) == 3
    s = _column(clusters.silhouette_samples(table.where("own < 3"), "k", ["p", "q"], "own"), "silhouette")
    d2, lab = dist[:120, :120] ** 2, np.arange(120) // 40
    want = [(min(d2[i, lab == g].mean() for g in range(3) if g != lab[i]) - d2[i, lab == lab[i]].sum() / 39) for i in range(120)]
    top = [max(min(d2[i, lab == g].mean() for g in range(3) if g != lab[i]), d2[i, lab == lab[i]].sum() / 39) for i in range(120)]
    assert np.allclose(s, np.array(want) / np.array(top))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9) if i != 4], "u long, v long, weight double")
    nodes = spark.createDataFrame([(i, {0: "x", 9: "y"}.get(i)) for i in range(11)], "node long, label string")
    for kind in (clusters.LabelPropagation(12), clusters.LabelSpreading(12)):
        told = {r["node"]: r["label"] for r in kind.fit_transform(nodes, edges).collect()}
        assert [told[i] for i in range(11)] == ["x"] * 5 + ["y"] * 5 + [None]


def test_neighbors(spark, df):
    rows = df.select("k", F.array(*COLUMNS).alias("v"), "y", "g")
    dist = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    order = np.argsort(dist, axis=1, kind="stable")
    near = order[:, :7]
    got = _column(neighbors.KNeighborsRegressor("k", "v", "y", 7).fit(rows).transform(rows.select("k", "v")), "prediction")
    assert np.allclose(got, Y[near].mean(1))
    lof = _column(neighbors.LocalOutlierFactor("k", "v", 10).fit_transform(rows), "lof")
    others = order[:, 1:11]
    reach = np.take_along_axis(dist, others, 1).max(1)
    density = 1 / (np.maximum(np.take_along_axis(dist, others, 1), reach[others]).mean(1) + 1e-10)
    assert np.allclose(lof, density[others].mean(1) / density)
    kde = _column(neighbors.KernelDensity("k", "v", 3, 0.7).fit(rows).score_samples(rows), "log_density")
    assert np.allclose(kde, np.log(np.exp(-(dist**2) / 2 / 0.49).mean(1)) - 1.5 * math.log(2 * math.pi) - 3 * math.log(0.7))
    nw = {r["point"]: r["prediction"] for r in neighbors.NadarayaWatson("a", "y", 0.5).at(df, [0.0, 1.0]).collect()}
    for p, v in nw.items():
        w = np.exp(-(((X[:, 0] - p) / 0.5) ** 2) / 2)
        assert math.isclose(v, (w * Y).sum() / w.sum(), rel_tol=1e-9)
    assert neighbors.CrossValidatedBandwidth([0.05, 0.4, 30.0]).resolve(df, "a", "y") == 0.4


def test_graphs(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 30, 40), r.integers(0, 30, 40), r.uniform(1, 9, 40).round(2), strict=True) if a != b]
    table = spark.createDataFrame(edges, "u long, v long, weight double")
    far = np.full((30, 30), np.inf)
    np.fill_diagonal(far, 0)
    for a, b, w in edges:
        far[a, b] = far[b, a] = min(far[a, b], w)
    for k, i, j in itertools.product(range(30), repeat=3):
        far[i, j] = min(far[i, j], far[i, k] + far[k, j])
    got = {x["node"]: x["distance"] for x in graphs.dijkstra(table, edges[0][0]).collect()}
    assert got.keys() == set(np.flatnonzero(np.isfinite(far[edges[0][0]])).tolist()) and all(math.isclose(far[edges[0][0], n], d, abs_tol=1e-9) for n, d in got.items())
    root, total = list(range(30)), 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a], total = b, total + w
    assert math.isclose(graphs.minimum_spanning_tree(table).agg(F.sum("weight")).first()[0], total)


def test_searches(df):
    make = lambda alpha: Ridge(COLUMNS, "y", alpha=alpha)
    found = model_selection.GridSearchCV(make, {"alpha": [1e6, 0.1, 1e3]}, scoring="r2")
    found.fit(df)
    assert found.best_params == {"alpha": 0.1} and len(found.results) == 3
    drawn = model_selection.RandomizedSearchCV(make, {"alpha": model_selection.LogUniform(1e-3, 1e3)}, 3, scoring="r2")
    drawn.fit(df)
    assert drawn.best_params["alpha"] == min(p["params"]["alpha"] for p in drawn.results)
    halved = model_selection.HalvingGridSearchCV(make, {"alpha": [1e6, 0.1, 1e3]}, ["k"], scoring="r2")
    halved.fit(df)
    assert halved.best_params == {"alpha": 0.1}
    score, others, share = model_selection.permutation_test_score(make(0.1), df, ["k"], scoring="r2", n_permutations=3)
    assert score > 0.9 > max(others) and share == 0.25
    assert len(model_selection.learning_curve(make(0.1), df, ["k"], shares=(0.5, 1.0), scoring="r2")) == 8
    fall = model_selection.permutation_importance(make(0.1).fit(df), df, COLUMNS, ["k"], "y", "prediction", "r2", 2)
    assert min(fall["a"]) > max(fall["b"]) > max(fall["c"])


def test_combined_estimators(df):
    logistic = lambda t, o: LogisticRegression(COLUMNS, t, o)
    three = df.withColumn("h", F.when(F.col("a") > 0.5, "x").when(F.col("a") < -0.5, "z").otherwise("m"))
    for kind in (model_selection.OneVsRestClassifier, model_selection.OneVsOneClassifier):
        right = kind(logistic, "h").fit(three).transform(three).where("h = prediction").count()
        assert right > (80 if kind is model_selection.OneVsRestClassifier else 105)
    tuned = model_selection.TunedThresholdClassifierCV(logistic, "g")
    assert (_column(tuned.fit(df).transform(df), "prediction") == G).mean() > 0.85 and 0 < tuned.threshold < 1
    for method in ("sigmoid", "isotonic"):
        p = _column(model_selection.CalibratedClassifierCV(logistic, "g", method=method).fit(df).transform(df), "probability")
        assert ((p - G) ** 2).mean() < 0.1
    few = df.withColumn("g", F.when(F.col("k") % 3 == 0, F.col("g")))
    trained = model_selection.SelfTrainingClassifier(lambda t: regression.LinearDiscriminantAnalysis(COLUMNS, t), "g").fit(few)
    assert (_column(trained.transform(df), "prediction") == G).mean() > 0.85
    chain = model_selection.RegressorChain(lambda c, t, o: LinearRegression(c, t, o), ["a", "b"], ["c", "y"]).fit(df).transform(df)
    assert np.corrcoef(_column(chain, "y_prediction"), Y)[0, 1] > 0.95


def test_encoders(spark, df):
    spline = encoding.SplineTransformer(["a"], 4, 3).fit(df).transform(df)
    names = [c for c in spline.columns if c.startswith("a_s")]
    s = np.stack([_column(spline, n) for n in names])
    assert len(names) == 6 and np.allclose(s.sum(0), 1) and (s >= -1e-12).all()
    holed = df.withColumn("y", F.when(F.col("k") % 6 == 0, None).otherwise(F.col("y")))
    full = _column(encoding.IterativeImputer([*COLUMNS, "y"]).fit(holed).transform(holed), "y")
    assert np.abs(full - Y).max() < 0.6
    near = _column(encoding.KNNImputer([*COLUMNS, "y"], ["k"], 1).fit(holed).transform(holed), "y")
    hole = np.arange(120) % 6 == 0
    want = [Y[~hole][((X[~hole] - x) ** 2).sum(1).argmin()] for x in X[hole]]
    assert np.allclose(near[hole], want) and np.allclose(near[~hole], Y[~hole])
    make = lambda c: LinearRegression(c, "y")
    assert encoding.RFE(make, COLUMNS, 2).fit(df).chosen == ["a", "b"]
    assert encoding.SelectFromModel(make, COLUMNS).fit(df).chosen == ["a"]
    assert encoding.SequentialFeatureSelector(make, COLUMNS, 2, scoring="r2").fit(df).chosen == ["a", "b"]
    texts = spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (3, None)], "k long, t string")
    hashed = encoding.HashingVectorizer("k", "t", 1000, norm="l1", alternate_sign=False).transform(texts)
    assert sorted((r["k"], round(r["value"], 6)) for r in hashed.collect()) == [(1, 0.333333), (1, 0.666667), (2, 1.0)]
    maps = spark.createDataFrame([(1, {"x": 1.0, "y": 2.0}), (2, {"z": 3.0})], "k long, m map<string,double>")
    vectors = encoding.DictVectorizer("k", "m").fit(maps)
    rows = vectors.transform(maps)
    assert sorted((r["k"], r["index"], r["value"]) for r in rows.collect()) == [(1, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)]
    assert {r["k"]: r["m"] for r in vectors.inverse(rows).collect()} == {1: {"x": 1.0, "y": 2.0}, 2: {"z": 3.0}}


def test_reports(spark, df):
    told = df.withColumn("p", F.when(F.col("k") % 7 == 0, 1 - F.col("g")).otherwise(F.col("g")))
    p = _column(told, "p")
    rows = {r["label"]: r for r in reports.classification_report(told, "g", "p").collect()}
    assert math.isclose(rows["1"]["precision"], G[p == 1].mean()) and math.isclose(rows["1"]["recall"], p[G == 1].mean()) and rows["macro avg"]["support"] == 120
    assert reports.adjusted_mutual_info(told, "g", "g") == pytest.approx(1) and abs(reports.adjusted_mutual_info(df, "g", "fold")) < 0.1
    v = reports.homogeneity_completeness_v_measure(told, "g", "g").first()
    assert v["v_measure"] == pytest.approx(1)
    cut = reports.metric_at_thresholds(df, "g", "a", lambda tn, fp, fn, tp: tp - fp).collect()
    assert all(math.isclose(r["value"], (G[X[:, 0] >= r["threshold"]] * 2 - 1).sum()) for r in cut) and len(cut) == 120
    assert reports.consensus_score([({1, 2}, {1}), ({3}, {2})], [({3}, {2}), ({1, 2}, {1})]) == 1.0


def test_model_files(df, tmp_path):
    model = LinearRegression(COLUMNS, "y").fit(df)
    data = models.save_model_bytes(model)
    assert np.allclose(_column(models.load_model_bytes(data).transform(df), "prediction"), _column(model.transform(df), "prediction"))
    with pytest.raises(ValueError):
        models.load_model_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError):
        models.load_model_bytes(models._HEAD.pack(models.MAGIC, 1, 0, 0)[:5])
    models.save_model(model, str(tmp_path / "m"))
    assert models.load_model(str(tmp_path / "m")).intercept == model.intercept
    assert models.load_model_json(models.save_model_json(model)).intercept == model.intercept
    assert "RegressionTable" in models.save_pmml(model)
    import onnxruntime

    for kind in (model, LogisticRegression(COLUMNS, "g").fit(df)):
        session = onnxruntime.InferenceSession(models.save_onnx_bytes(kind), providers=["CPUExecutionProvider"])
        got = session.run(["Y"], {"X": X.astype(np.float32)})[0][:, 0]
        assert np.allclose(got, _column(kind.transform(df), kind.output), atol=1e-3)


def test_sparse_matrices(spark):
    a, b = R.integers(0, 3, (4, 5)), R.integers(0, 3, (5, 2))
    make = lambda m: matrices.coo_matrix(spark.createDataFrame([(i, j, float(m[i, j])) for i, j in itertools.product(*map(range, m.shape))], "row int, col int, value double"), m.shape)

    def dense(m):
        out = np.zeros(m.shape)
        for r in m.summed().entries.collect():
            out[r["row"], r["col"]] = r["value"]
        return out

    assert (dense(make(a).matmul(make(b))) == a @ b).all() and (dense(make(a).transpose()) == a.T).all()
    assert (dense(matrices.hstack(make(a), make(a))) == np.hstack([a, a])).all() and (dense(matrices.vstack(make(b), make(b))) == np.vstack([b, b])).all()
    assert (dense(matrices.eye(spark, 3).add(matrices.diags(spark, [1, 2], 1))) == np.eye(3) + np.diag([1, 2], 1)).all()
    assert len(make(a).csr().first()["entries"]) <= 5


def test_checks(df):
    assert validation.check_x_y(df, COLUMNS, "y").count() == 120
    with pytest.raises(ValueError):
        validation.check_array(df.withColumn("a", F.lit(float("inf"))), COLUMNS)
    with pytest.raises(ValueError):
        validation.check_consistent_length(df, df.limit(3))
