"""Registered queries of trees, further linear models, splits, searches, neighbours, clusters, factors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import clusters, factors, graphs, model_selection, neighbors, regression, splits, trees
from tessera.operators.linear import LinearRegression, LogisticRegression, Ridge
from tessera.plans.queries import FEATURES, LINE, _coefficients, _covariance, register, table

# --- trees: splits of one column as SQL searches them ---

_STUMP = """v AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM v),
    b AS (SELECT (x + nx) / 2 AS t, sl / nl AS ml, (st - sl) / (nt - nl) AS mr, st / nt AS m FROM c WHERE nx IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, x LIMIT 1)"""
_side = "CASE WHEN l_quantity <= t THEN ml ELSE mr END"


def _lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*LINE, *(columns or ("prediction",)))


def _fitted(op, *columns: str):
    return lambda spark, sf_dir: _lines(op.fit_transform(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", *FEATURES)), *columns)


for _name, _op, _sql in (
    ("decision_tree_regressor", trees.DecisionTreeRegressor(["l_quantity"], "l_extendedprice", max_depth=1), _side),
    ("gradient_boosting_regressor", trees.GradientBoostingRegressor(["l_quantity"], "l_extendedprice", max_depth=1, n_estimators=1, learning_rate=0.5), f"m + 0.5 * ({_side} - m)"),
    ("hist_gradient_boosting_regressor", trees.HistGradientBoostingRegressor(["l_quantity"], "l_extendedprice", max_depth=1, n_estimators=1, learning_rate=0.1), f"m + 0.1 * ({_side} - m)"),
    ("voting_regressor", trees.VotingRegressor([trees.DecisionTreeRegressor(["l_quantity"], "l_extendedprice", max_depth=d) for d in (0, 1)]), f"(m + {_side}) / 2"),
    ("random_forest_regressor_without_bootstrap", trees.RandomForestRegressor(["l_quantity"], "l_extendedprice", max_depth=1, n_estimators=3, max_features=None, bootstrap=False), _side),
):
    register(_name, f"WITH {_STUMP} SELECT l_orderkey, l_linenumber, round({_sql}, 3) AS prediction FROM lineitem, b", 3)(_fitted(_op))

_GINI = """v AS (SELECT l_quantity AS x, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    c AS (SELECT x, lead(x) OVER w AS nx, sum(n) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(r) OVER w AS r, sum(n) OVER () AS tn, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(r) OVER () AS tr FROM v WINDOW w AS (ORDER BY x)),
    s AS (SELECT (x + nx) / 2 AS t, b / n AS pl, (tb - b) / (tn - n) AS pr FROM c WHERE nx IS NOT NULL ORDER BY (a * a + b * b + r * r) / n + ((ta - a) ** 2 + (tb - b) ** 2 + (tr - r) ** 2) / (tn - n) DESC, x LIMIT 1)"""
register("decision_tree_classifier", f"WITH {_GINI} SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= t THEN pl ELSE pr END, 6) AS p FROM lineitem, s")(
    lambda spark, sf_dir: trees.DecisionTreeClassifier(["l_quantity"], "l_returnflag", max_depth=1).fit_transform(table(spark, sf_dir, "lineitem")).select(*LINE, F.col("prediction_probability")[1].alias("p"))
)
_small = {"max_depth": 3}
for _name, _op in {
    "random_forest_classifier": trees.RandomForestClassifier(FEATURES, "l_returnflag", n_estimators=5, **_small),
    "extra_trees_classifier": trees.ExtraTreesClassifier(FEATURES, "l_returnflag", n_estimators=5, **_small),
    "bagging_classifier": trees.BaggingClassifier(FEATURES, "l_returnflag", n_estimators=5, **_small),
    "ada_boost_classifier": trees.AdaBoostClassifier(FEATURES, "l_returnflag", n_estimators=3, max_depth=2),
    "gradient_boosting_classifier": trees.GradientBoostingClassifier(FEATURES, "l_returnflag", n_estimators=2, max_depth=2),
    "hist_gradient_boosting_classifier": trees.HistGradientBoostingClassifier(FEATURES, "l_returnflag", n_estimators=2, max_depth=2),
    "random_forest_regressor": trees.RandomForestRegressor(["l_quantity", "l_tax"], "l_extendedprice", n_estimators=5, **_small),
    "extra_trees_regressor": trees.ExtraTreesRegressor(["l_quantity", "l_tax"], "l_extendedprice", n_estimators=5, **_small),
    "ada_boost_regressor": trees.AdaBoostRegressor(["l_quantity", "l_tax"], "l_extendedprice", n_estimators=3),
}.items():
    register(_name, None)(_fitted(_op))
register("isolation_forest", None)(_fitted(trees.IsolationForest(FEATURES, 10), "anomaly"))

# --- linear models: closed forms of one column, and of a column with two values ---

_AS = "SELECT l_orderkey, l_linenumber"
_CLASSES = "SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1"


def _argmax(score: str, more: str) -> str:
    return f"""WITH c AS ({_CLASSES}), {more} SELECT l_orderkey, l_linenumber, prediction FROM (SELECT l_orderkey, l_linenumber, k AS prediction,
        row_number() OVER (PARTITION BY line ORDER BY {score} DESC, k) AS r FROM (SELECT *, row_number() OVER () AS line FROM lineitem), c, p) WHERE r = 1"""


register("linear_discriminant_analysis", _argmax("l_quantity * m / pv - 0.5 * m * m / pv + ln(n / tn)", "p AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS pv, sum(n) AS tn FROM c)"))(_fitted(regression.LinearDiscriminantAnalysis(["l_quantity"], "l_returnflag")))
register("quadratic_discriminant_analysis", _argmax("-0.5 * (l_quantity - m) ** 2 / v - 0.5 * ln(v) + ln(n / tn)", "p AS (SELECT sum(n) AS tn FROM c)"))(_fitted(regression.QuadraticDiscriminantAnalysis(["l_quantity"], "l_returnflag")))
register(
    "ridge_classifier",
    _argmax("(2 * n / tn - 1) + 2 * n * (m - tm) / (txx + 10) * (l_quantity - tm)", "p AS (SELECT count(*) AS tn, avg(l_quantity) AS tm, count(*) * var_pop(l_quantity) AS txx FROM lineitem)"),
)(_fitted(regression.RidgeClassifier(["l_quantity"], "l_returnflag", alpha=10.0)))



def _first():
    return F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.0)


_group = "(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)"
for _name, _kind, _target in (("poisson_regressor", regression.PoissonRegressor, "l_quantity"), ("gamma_regressor", regression.GammaRegressor, "l_extendedprice"), ("tweedie_regressor", lambda *a, **k: regression.TweedieRegressor(*a, power=1.5, **k), "l_extendedprice")):
    register(_name, f"{_AS}, round(avg({_target}) OVER (PARTITION BY {_group}), 2) AS prediction FROM lineitem", 2)(
        lambda spark, sf_dir, kind=_kind, target=_target: _lines(kind(["first"], target, alpha=0.0).fit_transform(table(spark, sf_dir, "lineitem").withColumn("first", _first())))
    )
register("logistic_regression_of_groups", f"{_AS}, round(avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY {_group}), 4) AS probability FROM lineitem", 4)(
    lambda spark, sf_dir: _lines(LogisticRegression(["first"], "y", C=1e12).fit_transform(table(spark, sf_dir, "lineitem").withColumns({"first": _first(), "y": (F.col("l_returnflag") == "N").cast("double")})), "probability")
)
register("multinomial_logistic_regression", f"{_AS}, {', '.join(f'''round(avg(CASE WHEN l_returnflag = '{k}' THEN 1 ELSE 0 END) OVER (PARTITION BY {_group}), 4) AS p{k.lower()}''' for k in 'ANR')} FROM lineitem", 4)(
    lambda spark, sf_dir: regression.MultinomialLogisticRegression(["first"], "l_returnflag", C=1e12).fit_transform(table(spark, sf_dir, "lineitem").withColumn("first", _first())).select(*LINE, *[F.col("prediction_probability")[i].alias(f"p{k}") for i, k in enumerate("anr")])
)
_XY = "SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n, var_pop(l_quantity) AS sxx, covar_pop(l_quantity, l_extendedprice) AS sxy FROM lineitem"
_SOFT = "sign(sxy) * greatest(abs(sxy) - 1000, 0) / sxx"
for _name, _op, _b in (
    ("lars", regression.Lars(["l_quantity"], "l_extendedprice"), "sxy / sxx"),
    ("lasso_lars", regression.LassoLars(["l_quantity"], "l_extendedprice", alpha=1000.0), _SOFT),
    ("lasso_lars_ic", regression.LassoLarsIC(["l_quantity"], "l_extendedprice"), "CASE WHEN sxy * sxy / sxx / (n / (n - 2) * (syy - sxy * sxy / sxx)) * n > 2 THEN sxy / sxx ELSE 0 END"),
):
    _stats = _XY.replace(" FROM lineitem", ", var_pop(l_extendedprice) AS syy FROM lineitem")
    register(_name, f"WITH s AS ({_stats}) SELECT 'l_quantity' AS name, round({_b}, 4) AS weight FROM s UNION ALL SELECT 'intercept', round(my - mx * ({_b}), 4) FROM s", 4)(lambda spark, sf_dir, op=_op: _coefficients(spark, op.fit(table(spark, sf_dir, "lineitem"))))
register("multi_task_lasso", f"WITH s AS ({_XY}) {_AS}, round(my + ({_SOFT}) * (l_quantity - mx), 3) AS l_extendedprice_prediction FROM lineitem, s", 3)(_fitted(regression.MultiTaskLasso(["l_quantity"], ["l_extendedprice"], alpha=1000.0), "l_extendedprice_prediction"))
register(
    "ridge_cv",
    f"""WITH s AS ({_XY}), a AS (SELECT unnest([0.1, 100000000.0]) AS alpha), f AS (SELECT alpha, n * sxy / (n * sxx + alpha) AS b, mx, my, n, n * sxx + alpha AS q FROM s, a),
        e AS (SELECT alpha, b, mx, my, avg(((l_extendedprice - my - b * (l_quantity - mx)) / (1 - 1 / n - (l_quantity - mx) ** 2 / q)) ** 2) AS loss FROM lineitem, f GROUP BY 1, 2, 3, 4), w AS (SELECT * FROM e ORDER BY loss, alpha LIMIT 1)
        SELECT 'l_quantity' AS name, round(b, 4) AS weight FROM w UNION ALL SELECT 'intercept', round(my - mx * b, 4) FROM w""",
    4,
)(lambda spark, sf_dir: _coefficients(spark, regression.RidgeCV(["l_quantity"], "l_extendedprice", alphas=(0.1, 1e8)).fit(table(spark, sf_dir, "lineitem"))))
register(
    "isotonic_regression",
    f"""WITH v AS (SELECT l_discount AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
        m AS (SELECT a.x AS lo, b.x AS hi, sum(v.s) / sum(v.n) AS mean FROM v AS a, v AS b, v WHERE v.x BETWEEN a.x AND b.x GROUP BY 1, 2),
        g AS (SELECT x, max(least_) AS y FROM (SELECT v.x, m.lo, min(m.mean) AS least_ FROM v, m WHERE m.lo <= v.x AND m.hi >= v.x GROUP BY 1, 2) GROUP BY 1)
        {_AS}, round(y, 3) AS prediction FROM lineitem, g WHERE x = l_discount""",
    3,
)(_fitted(regression.IsotonicRegression("l_discount", "l_extendedprice")))
for _name, _op in {
    "lasso_cv": regression.LassoCV(["l_quantity", "l_tax"], "l_extendedprice", LINE, n_alphas=10),
    "elastic_net_cv": regression.ElasticNetCV(["l_quantity", "l_tax"], "l_extendedprice", LINE, n_alphas=10),
    "orthogonal_matching_pursuit_cv": regression.OrthogonalMatchingPursuitCV(["l_quantity", "l_tax"], "l_extendedprice", LINE),
    "ard_regression": regression.ARDRegression(["l_quantity", "l_tax"], "l_extendedprice"),
    "quantile_regressor": regression.QuantileRegressor(["l_quantity"], "l_extendedprice", quantile=0.8),
    "ransac_regressor": regression.RANSACRegressor(["l_quantity"], "l_extendedprice", LINE),
    "linear_svr": regression.LinearSVR(["l_quantity"], "l_extendedprice"),
    "sgd_regressor": regression.SGDRegressor(["l_quantity"], "l_extendedprice"),
}.items():
    register(_name, None, 2)(lambda spark, sf_dir, op=_op: _coefficients(spark, op.fit(table(spark, sf_dir, "lineitem"))))
for _name, _op in {
    "linear_svc": regression.LinearSVC(["l_quantity", "l_discount"], "l_returnflag"),
    "ridge_classifier_cv": regression.RidgeClassifierCV(["l_quantity"], "l_returnflag"),
    "sgd_classifier": regression.SGDClassifier(["l_quantity", "l_discount"], "l_returnflag", epochs=2),
    "perceptron": regression.Perceptron(["l_quantity", "l_discount"], "l_returnflag", epochs=2),
    "passive_aggressive_classifier": regression.PassiveAggressiveClassifier(["l_quantity", "l_discount"], "l_returnflag", epochs=2),
}.items():
    register(_name, None)(_fitted(_op))

# --- splits, in orders that SQL repeats by md5 ---

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"
_place = "row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || {k} || '|' || o_orderkey), o_orderkey) - 1"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


register("shuffle_split", f"SELECT o_orderkey, split, CASE WHEN r < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM (SELECT o_orderkey, split, {_place.format(by='split', seed=3, k='split')} AS r, count(*) OVER (PARTITION BY split) AS n FROM orders, (SELECT unnest([0, 1])::INTEGER AS split))")(
    lambda spark, sf_dir: splits.shuffle_split(_orders(spark, sf_dir), ["o_orderkey"], 2, 0.2, 3).select("o_orderkey", "split", "part")
)
register("stratified_shuffle_split", f"SELECT o_orderkey, split, CASE WHEN r < round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM (SELECT o_orderkey, split, {_place.format(by='split, o_orderstatus', seed=3, k='split')} AS r, count(*) OVER (PARTITION BY split, o_orderstatus) AS n FROM orders, (SELECT unnest([0, 1])::INTEGER AS split))")(
    lambda spark, sf_dir: splits.stratified_shuffle_split(_orders(spark, sf_dir), ["o_orderkey"], "o_orderstatus", 2, 0.2, 3).select("o_orderkey", "split", "part")
)
register("repeated_k_fold", f"SELECT o_orderkey, repeat, (r % 4)::INTEGER AS fold FROM (SELECT o_orderkey, repeat, {_place.format(by='repeat', seed=1, k='repeat')} AS r FROM orders, (SELECT unnest([0, 1])::INTEGER AS repeat))")(
    lambda spark, sf_dir: splits.repeated_k_fold(_orders(spark, sf_dir), ["o_orderkey"], 4, 2, 1).select("o_orderkey", "repeat", "fold")
)
register("repeated_stratified_k_fold", "SELECT o_orderkey, repeat, ((row_number() OVER (PARTITION BY repeat ORDER BY o_orderstatus, md5('1|' || repeat || '|' || o_orderkey), o_orderkey) - 1) % 4)::INTEGER AS fold FROM orders, (SELECT unnest([0, 1])::INTEGER AS repeat)")(
    lambda spark, sf_dir: splits.repeated_stratified_k_fold(_orders(spark, sf_dir), ["o_orderkey"], "o_orderstatus", 4, 2, 1).select("o_orderkey", "repeat", "fold")
)
register("leave_one_out", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS fold FROM nation")(lambda spark, sf_dir: splits.leave_one_out(table(spark, sf_dir, "nation").select("n_nationkey"), ["n_nationkey"]).select("n_nationkey", "fold"))
register("leave_p_out", "SELECT a.n_nationkey AS first, b.n_nationkey AS second FROM nation AS a, nation AS b WHERE a.n_nationkey < b.n_nationkey")(lambda spark, sf_dir: splits.leave_p_out(table(spark, sf_dir, "nation"), "n_nationkey", 2).select(F.col("tests")[0].alias("first"), F.col("tests")[1].alias("second")))
register(
    "leave_p_groups_out",
    """WITH g AS (SELECT DISTINCT o_orderstatus AS s FROM orders), p AS (SELECT a.s AS a, b.s AS b, (row_number() OVER (ORDER BY a.s, b.s) - 1)::INTEGER AS split FROM g AS a, g AS b WHERE a.s < b.s)
       SELECT o_orderkey, split, CASE WHEN o_orderstatus IN (a, b) THEN 'test' ELSE 'train' END AS part FROM orders, p""",
)(lambda spark, sf_dir: splits.leave_p_groups_out(_orders(spark, sf_dir), "o_orderstatus", 2).select("o_orderkey", "split", "part"))
register("group_shuffle_split", "WITH g AS (SELECT DISTINCT o_orderpriority AS p FROM orders), r AS (SELECT p, split, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || split || '|' || p), p) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM g, (SELECT unnest([0, 1])::INTEGER AS split)) SELECT o_orderkey, split, CASE WHEN r < ceil(n * 0.4) THEN 'test' ELSE 'train' END AS part FROM orders, r WHERE p = o_orderpriority")(
    lambda spark, sf_dir: splits.group_shuffle_split(_orders(spark, sf_dir), "o_orderpriority", 2, 0.4).select("o_orderkey", "split", "part")
)
register("stratified_group_k_fold", None)(lambda spark, sf_dir: splits.stratified_group_k_fold(_orders(spark, sf_dir), "o_orderstatus", "o_orderpriority", 2).groupBy("fold").agg(F.count("*").alias("n")))

# --- model selection ---

_FOLDED = "SELECT *, (l_linenumber % 3)::INTEGER AS fold FROM lineitem"
_BY_FOLD = f"WITH l AS ({_FOLDED}), s AS (SELECT f AS fold, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) AS b FROM l, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f GROUP BY 1)"


def _folded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_linenumber") % 3).cast("int"))


_ols = LinearRegression(["l_quantity"], "l_extendedprice")
register("cross_val_score", f"{_BY_FOLD} SELECT fold, round(1 - sum((l_extendedprice - my - b * (l_quantity - mx)) ** 2) / (count(*) * var_pop(l_extendedprice)), 6) AS score FROM l JOIN s USING (fold) GROUP BY 1")(
    lambda spark, sf_dir: spark.createDataFrame([(r["fold"], r["test_score"]) for r in model_selection.cross_validate(_ols, _folded(spark, sf_dir), scoring="r2")], "fold int, score double")
)
register("cross_val_predict", f"{_BY_FOLD} SELECT l_orderkey, l_linenumber, round(my + b * (l_quantity - mx), 3) AS prediction FROM l JOIN s USING (fold)", 3)(lambda spark, sf_dir: _lines(model_selection.cross_val_predict(_ols, _folded(spark, sf_dir))))
register("grid_search_cv", f"WITH s AS ({_XY}) SELECT 'l_quantity' AS name, round(n * sxy / (n * sxx + 1.0), 4) AS weight FROM s UNION ALL SELECT 'intercept', round(my - mx * n * sxy / (n * sxx + 1.0), 4) FROM s", 4)(
    lambda spark, sf_dir: _coefficients(spark, model_selection.GridSearchCV(lambda alpha: Ridge(["l_quantity"], "l_extendedprice", alpha=alpha), {"alpha": [1e9, 1.0]}, scoring="neg_mean_squared_error").fit(_folded(spark, sf_dir)))
)
register("partial_dependence", f"WITH s AS ({_XY}) SELECT value, round(my + sxy / sxx * (value - mx), 4) AS average FROM s, (SELECT unnest([1.0, 10.0, 40.0])::DOUBLE AS value)", 4)(
    lambda spark, sf_dir: model_selection.partial_dependence(_ols.fit(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "lineitem"), "l_quantity", [1, 10, 40], "prediction")
)
register("transformed_target_regressor", "WITH s AS (SELECT avg(l_quantity) AS mx, avg(ln(l_extendedprice)) AS my, covar_pop(l_quantity, ln(l_extendedprice)) / var_pop(l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(exp(my + b * (l_quantity - mx)), 2) AS prediction FROM lineitem, s", 2)(
    lambda spark, sf_dir: _lines(model_selection.TransformedTargetRegressor(lambda t, o: LinearRegression(["l_quantity"], t, o), "l_extendedprice", F.ln, F.exp).fit_transform(table(spark, sf_dir, "lineitem")))
)
register("fixed_threshold_classifier", f"{_AS}, (avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY {_group}) >= 0.4)::INTEGER AS prediction FROM lineitem")(
    lambda spark, sf_dir: _lines(model_selection.FixedThresholdClassifier(lambda t, o: LogisticRegression(["first"], t, o, C=1e12), "y", 0.4).fit_transform(table(spark, sf_dir, "lineitem").withColumns({"first": _first(), "y": (F.col("l_returnflag") == "N").cast("double")})))
)
register("one_vs_rest_classifier", None)(_fitted(model_selection.OneVsRestClassifier(lambda t, o: LogisticRegression(["l_quantity", "l_discount"], t, o), "l_returnflag")))
register("one_vs_one_classifier", None)(_fitted(model_selection.OneVsOneClassifier(lambda t, o: LogisticRegression(["l_quantity", "l_discount"], t, o), "l_returnflag")))
register("output_code_classifier", None)(_fitted(model_selection.OutputCodeClassifier(lambda t, o: LogisticRegression(["l_quantity", "l_discount"], t, o), "l_returnflag")))
register("multi_output_regressor", f"WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, avg(l_tax) AS mt, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) AS b, covar_pop(l_quantity, l_tax) / var_pop(l_quantity) AS c FROM lineitem) {_AS}, round(my + b * (l_quantity - mx), 4) AS l_extendedprice_prediction, round(mt + c * (l_quantity - mx), 4) + 0.0 AS l_tax_prediction FROM lineitem, s", 4)(
    _fitted(model_selection.MultiOutputRegressor(lambda t, o: LinearRegression(["l_quantity"], t, o), ["l_extendedprice", "l_tax"]), "l_extendedprice_prediction", "l_tax_prediction")
)

# --- neighbours of embeddings: every embedding whose vec_id is divisible by 100, against all ---

_PAIRS = """q AS (SELECT vec_id AS a, embedding AS va FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT a, e.vec_id AS b, label, sqrt(list_sum(list_transform(list_zip(va, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance FROM q, embeddings AS e)"""


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir) -> DataFrame:
    return _embeddings(spark, sf_dir).where("vec_id % 100 = 0").select("vec_id", "embedding")


register("k_neighbors_classifier", f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d), v AS (SELECT a, label, count(*) AS n FROM k WHERE r <= 5 GROUP BY 1, 2) SELECT vec_id, prediction FROM (SELECT a AS vec_id, label AS prediction, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS r FROM v) WHERE r = 1")(
    lambda spark, sf_dir: neighbors.KNeighborsClassifier("vec_id", "embedding", "label", 5).fit(_embeddings(spark, sf_dir)).transform(_asked(spark, sf_dir)).select("vec_id", "prediction")
)
register("k_neighbors_regressor", f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d) SELECT a AS vec_id, round(avg(label), 6) AS prediction FROM k WHERE r <= 5 GROUP BY 1")(
    lambda spark, sf_dir: neighbors.KNeighborsRegressor("vec_id", "embedding", "label", 5).fit(_embeddings(spark, sf_dir)).transform(_asked(spark, sf_dir)).select("vec_id", "prediction")
)
register("radius_neighbors_regressor", f"WITH {_PAIRS} SELECT vec_id, prediction FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) LEFT JOIN (SELECT a AS vec_id, round(avg(label), 6) AS prediction FROM d WHERE distance <= 1.2 GROUP BY 1) USING (vec_id)")(
    lambda spark, sf_dir: neighbors.RadiusNeighborsRegressor("vec_id", "embedding", "label", radius=1.2).fit(_embeddings(spark, sf_dir)).transform(_asked(spark, sf_dir)).select("vec_id", "prediction")
)

# --- factors and covariances ---

_TWO = ["l_quantity", "l_discount"]
_triples = [(a, b) for a in _TWO for b in _TWO]
_TRACE = "(var_pop(l_quantity) + var_pop(l_discount))"
_ALPHA = "((var_pop(l_quantity) ** 2 + var_pop(l_discount) ** 2 + 2 * covar_pop(l_quantity, l_discount) ** 2) / 4)"
_SHARE = f"least(1, ({_ALPHA} + ({_TRACE} / 2) ** 2) / ((count(*) + 1) * ({_ALPHA} - ({_TRACE} / 2) ** 2 / 2)))"
register("oas", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round((1 - {_SHARE}) * covar_pop({a}, {b}) + {_SHARE} * {int(a == b)} * {_TRACE} / 2, 5) + 0.0 AS covariance FROM lineitem" for a, b in _triples), 5)(lambda spark, sf_dir: _covariance(spark, factors.OAS(_TWO).fit(table(spark, sf_dir, "lineitem"))))
register("graphical_lasso", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({f'covar_pop({a}, {b})' if a == b else f'sign(covar_pop({a}, {b})) * greatest(abs(covar_pop({a}, {b})) - 0.0001, 0)'}, 6) + 0.0 AS covariance FROM lineitem" for a, b in _triples))(
    lambda spark, sf_dir: _covariance(spark, factors.GraphicalLasso(_TWO, 0.0001).fit(table(spark, sf_dir, "lineitem")))
)
register(
    "truncated_svd",
    """WITH s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_linenumber) AS b, sum(l_linenumber * l_linenumber)::DOUBLE AS d FROM lineitem), e AS (SELECT *, (a + d) / 2 + sqrt((a - d) ** 2 / 4 + b * b) AS l FROM s),
       v AS (SELECT b / sqrt(b * b + (l - a) ** 2) AS x, (l - a) / sqrt(b * b + (l - a) ** 2) AS y FROM e) SELECT l_orderkey, l_linenumber, round(l_quantity * x + l_linenumber * y, 4) AS svd1 FROM lineitem, v""",
    4,
)(lambda spark, sf_dir: _lines(factors.TruncatedSVD(["l_quantity", "l_linenumber"], 1).fit_transform(table(spark, sf_dir, "lineitem")), "svd1"))
_fitted_factors = {
    "factor_analysis": (factors.FactorAnalysis(FEATURES), "factor1"),
    "fast_ica": (factors.FastICA(["l_quantity", "l_discount"]), "ic1"),
    "gaussian_random_projection": (factors.GaussianRandomProjection(FEATURES, 2), "p1"),
    "sparse_random_projection": (factors.SparseRandomProjection(FEATURES, 2), "p1"),
    "rbf_sampler": (factors.RBFSampler(_TWO, n_components=3), "f1"),
    "additive_chi2_sampler": (factors.AdditiveChi2Sampler(_TWO), "l_quantity_cos1"),
}
for _name, (_op, _out) in _fitted_factors.items():
    register(_name, None, 4)(_fitted(_op, _out))
register("min_cov_det", None)(lambda spark, sf_dir: _covariance(spark, factors.MinCovDet(_TWO).fit(table(spark, sf_dir, "lineitem"))))
register("incremental_pca", None, 3)(lambda spark, sf_dir: _lines(factors.IncrementalPCA(["l_quantity", "l_extendedprice"], 1).fit_transform(table(spark, sf_dir, "lineitem")), "pc1"))
register("pls_regression", f"WITH s AS ({_XY}) {_AS}, round(my + sxy / sxx * (l_quantity - mx), 3) AS l_extendedprice_prediction FROM lineitem, s", 3)(_fitted(factors.PLSRegression(["l_quantity"], ["l_extendedprice"], 1), "l_extendedprice_prediction"))

# --- clusters ---

register("gaussian_mixture", None)(_fitted(clusters.GaussianMixture(["l_quantity", "l_discount"], 2, key=LINE, max_iter=5), "component"))
register("mini_batch_k_means", None)(_fitted(clusters.MiniBatchKMeans(["l_quantity", "l_discount"], LINE, 3, batches=3), "cluster"))
register("bisecting_k_means", None)(_fitted(clusters.BisectingKMeans(["l_quantity", "l_discount"], 3, max_iter=5), "cluster"))
register(
    "silhouette_samples",
    """WITH p AS (SELECT a.c_custkey AS k, a.c_mktsegment AS own, b.c_mktsegment AS l, sum((a.c_acctbal - b.c_acctbal) ** 2) AS d, count(*) AS n FROM customer AS a, customer AS b GROUP BY 1, 2, 3),
       s AS (SELECT k, max(CASE WHEN own = l THEN d / (n - 1) END) AS a, min(CASE WHEN own <> l THEN d / n END) AS b FROM p GROUP BY 1) SELECT k AS c_custkey, round((b - a) / greatest(a, b), 6) AS silhouette FROM s""",
)(lambda spark, sf_dir: clusters.silhouette_samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"], "c_mktsegment"))

# --- graphs and numbers: each order hangs on its customer ---


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((-F.col("o_custkey") - 1).cast("long").alias("u"), F.col("o_orderkey").cast("long").alias("v"), F.col("o_totalprice").alias("weight"))


register("connected_components", "SELECT o_orderkey::BIGINT AS node, (-o_custkey - 1)::BIGINT AS component FROM orders")(
    lambda spark, sf_dir: graphs.connected_components(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("node")), _edges(spark, sf_dir))
)
register("dijkstra", "WITH c AS (SELECT min(o_custkey) AS c FROM orders) SELECT (-c - 1)::BIGINT AS node, 0.0::DOUBLE AS distance FROM c UNION ALL SELECT o_orderkey, round(o_totalprice, 4) FROM orders, c WHERE o_custkey = c", 4)(
    lambda spark, sf_dir: graphs.dijkstra(_edges(spark, sf_dir), -table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0] - 1)
)
register("minimum_spanning_tree", "SELECT (-o_custkey - 1)::BIGINT AS u, o_orderkey::BIGINT AS v, round(o_totalprice, 4) AS weight FROM orders", 4)(lambda spark, sf_dir: graphs.minimum_spanning_tree(_edges(spark, sf_dir)))
register("lgamma", "SELECT l_orderkey, l_linenumber, round(lgamma(l_quantity), 6) AS lgamma FROM lineitem")(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select(*LINE, numeric.applied(numeric.lgamma, F.col("l_quantity")).alias("lgamma")))
