"""Trees against plain split searches."""

import numpy as np
import pytest

from tessera.operators import trees

R = np.random.default_rng(5)
X = np.round(R.normal(size=(400, 3)), 1)
Y = np.where(X[:, 0] > 0.3, 2.0, np.where(X[:, 1] > -0.2, 1.0, 0.0)) + R.normal(size=400) * 0.01
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(*map(float, x), float(y), ["low", "mid", "top"][int(round(y))]) for x, y in zip(X, Y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, label string").repartition(3).cache()


def _plain(x, y, depth):
    """The mean of y in each leaf of a greedy tree by squared error, row by row."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            known = np.unique(x[:, j])
            for t in (known[1:] + known[:-1]) / 2:
                m = x[:, j] <= t
                worth = y[m].sum() ** 2 / m.sum() + y[~m].sum() ** 2 / (~m).sum()
                if best is None or worth > best[0] + 1e-9:
                    best = (worth, m)
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-9:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for m in (best[1], ~best[1]):
        out[m] = _plain(x[m], y[m], depth - 1)
    return out


def _predicted(model, df, column="prediction"):
    return {(r["a"], r["b"], r["c"], r["y"]): r[column] for r in model.transform(df).collect()}


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_regression_tree_is_the_greedy_one(df, depth):
    got = _predicted(trees.DecisionTreeRegressor(COLUMNS, "y", max_depth=depth).fit(df), df)
    want = _plain(X, Y, depth)
    assert max(abs(got[(*map(float, x), float(y))] - w) for x, y, w in zip(X, Y, want, strict=True)) < 1e-9


def test_boosting_is_trees_on_residuals(df):
    got = _predicted(trees.GradientBoostingRegressor(COLUMNS, "y", max_depth=2, n_estimators=3, learning_rate=0.5).fit(df), df)
    want = np.full(len(Y), Y.mean())
    for _ in range(3):
        want = want + 0.5 * _plain(X, Y - want, 2)
    assert max(abs(got[(*map(float, x), float(y))] - w) for x, y, w in zip(X, Y, want, strict=True)) < 1e-9


@pytest.mark.parametrize("kind", ["DecisionTreeClassifier", "RandomForestClassifier", "ExtraTreesClassifier", "BaggingClassifier", "AdaBoostClassifier", "GradientBoostingClassifier", "HistGradientBoostingClassifier"])
def test_classifiers_learn(df, kind):
    more = {} if kind == "DecisionTreeClassifier" else {"n_estimators": 20, "max_features": None} if kind == "ExtraTreesClassifier" else {"n_estimators": 8}
    depth = 2 if kind == "AdaBoostClassifier" else 4
    model = getattr(trees, kind)(COLUMNS, "label", max_depth=depth, **more).fit(df)
    rows = model.transform(df).collect()
    assert sum(r["label"] == r["prediction"] for r in rows) >= 0.9 * len(rows)
    assert all(abs(sum(r["prediction_probability"]) - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("kind", ["ExtraTreeRegressor", "RandomForestRegressor", "ExtraTreesRegressor", "BaggingRegressor", "AdaBoostRegressor", "HistGradientBoostingRegressor"])
def test_regressors_learn(df, kind):
    more = {} if kind == "ExtraTreeRegressor" else {"n_estimators": 20, "max_features": None} if kind == "ExtraTreesRegressor" else {"n_estimators": 10}
    got = _predicted(getattr(trees, kind)(COLUMNS, "y", max_depth=6, **more).fit(df), df)
    off = np.array([got[(*map(float, x), float(y))] - y for x, y in zip(X, Y, strict=True)])
    assert (off**2).mean() < 0.4 * Y.var()


def test_isolation_embedding_votes_and_text(spark, df):
    far = df.unionByName(spark.createDataFrame([(9.0, -9.0, 9.0, 0.0, "low")], df.schema))
    rows = trees.IsolationForest(COLUMNS, 30).fit(far).transform(far).orderBy("anomaly", ascending=False).take(1)
    assert rows[0]["a"] == 9.0
    assert len(trees.RandomTreesEmbedding(COLUMNS, 4, 3).fit(df).transform(df).first()["leaf"]) == 4
    members = [trees.DecisionTreeClassifier(COLUMNS, "label", max_depth=d) for d in (1, 3, 4)]
    for voting in ("hard", "soft"):
        rows = trees.VotingClassifier(members, voting=voting).fit(df).transform(df).collect()
        assert sum(r["label"] == r["prediction"] for r in rows) >= 0.9 * len(rows)
    got = trees.VotingRegressor([trees.DecisionTreeRegressor(COLUMNS, "y", max_depth=d) for d in (0, 1)]).fit(df).transform(df).first()
    assert got["prediction"] > 0
    text = trees.export_text(trees.DecisionTreeRegressor(COLUMNS, "y", max_depth=1).fit(df))
    assert text.startswith("|--- a <= 0.3") and text.count("value") == 2


def test_missing_values_and_no_rows(spark, df):
    holed = df.withColumn("a", __import__("pyspark.sql.functions", fromlist=["when"]).expr("if(b > 1, null, a)"))
    assert trees.DecisionTreeRegressor(COLUMNS, "y").fit(holed).transform(holed).where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        trees.DecisionTreeRegressor(COLUMNS, "y").fit(df.where("false"))
