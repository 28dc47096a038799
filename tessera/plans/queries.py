"""Registered queries: each applies one operator to a whole table, beside the SQL that must give the same rows.

Doubles are rounded on both sides, since sums are added in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tessera.operators import bayes, decomposition, dummy, linear, metrics, pairwise, preprocess, quantile, selection, splits, text
from tessera.operators.base import Estimator
from tessera.streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LINE = ["l_orderkey", "l_linenumber"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places; -0 becomes 0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`").cast("double"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def register(name: str, sql: str | None, digits: int = 6) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def _applied(op, name: str, keys: list[str], out: list[str], source: str, rename: dict[str, str] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(*dict.fromkeys([*keys, *getattr(op, "columns", [])]))
        model = op.fit(df) if isinstance(op, Estimator) else op
        result = model.transform(df)
        return result.select(*keys, *[F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in out])

    return query


# --- scaling and projections of lineitem ---

_per_column = {
    "standard_scaler": (preprocess.StandardScaler(FEATURES), "({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"),
    "min_max_scaler": (preprocess.MinMaxScaler(FEATURES), "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"),
    "min_max_scaler_range_clip": (preprocess.MinMaxScaler(FEATURES, (-1.0, 1.0), clip=True), "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 2 - 1"),
    "max_abs_scaler": (preprocess.MaxAbsScaler(FEATURES), "{c} / max(abs({c})) OVER ()"),
    "robust_scaler": (preprocess.RobustScaler(FEATURES), "({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())"),
    "normalizer_l2": (preprocess.Normalizer(FEATURES), "{c} / sqrt(" + " + ".join(f"{c} * {c}" for c in FEATURES) + ")"),
    "normalizer_l1": (preprocess.Normalizer(FEATURES, "l1"), "{c} / (" + " + ".join(f"abs({c})" for c in FEATURES) + ")"),
    "normalizer_max": (preprocess.Normalizer(FEATURES, "max"), "{c} / greatest(" + ", ".join(f"abs({c})" for c in FEATURES) + ")"),
    "binarizer": (preprocess.Binarizer(FEATURES, 0.05), "CASE WHEN {c} > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "function_transformer": (preprocess.FunctionTransformer(FEATURES, F.log1p), "ln(1 + {c})"),
}
for _name, (_op, _sql) in _per_column.items():
    register(_name, "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_sql.format(c=c)}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM lineitem")(_applied(_op, _name, LINE, FEATURES, "lineitem"))

for _strategy, _edge in (("uniform", "(SELECT min({c}) + (max({c}) - min({c})) * {k} / 4 FROM lineitem)"), ("quantile", "(SELECT quantile_cont({c}, {q}) FROM lineitem)")):
    _columns = ["l_quantity", "l_extendedprice"]
    _bins = ", ".join("CAST(" + " + ".join(f"CASE WHEN {c} >= {_edge.format(c=c, k=k, q=k / 4)} THEN 1 ELSE 0 END" for k in (1, 2, 3)) + f" AS DOUBLE) AS {c}" for c in _columns)
    register(f"kbins_{_strategy}", f"SELECT l_orderkey, l_linenumber, {_bins} FROM lineitem")(_applied(preprocess.KBinsDiscretizer(_columns, 4, _strategy), "", LINE, _columns, "lineitem"))

_poly = preprocess.PolynomialFeatures(["l_quantity", "l_discount"], 2)
register(
    "polynomial_features",
    "SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS one, l_quantity AS q, l_discount AS d, l_quantity * l_quantity AS qq, round(l_quantity * l_discount, 6) AS qd, round(l_discount * l_discount, 6) AS dd FROM lineitem",
)(_applied(_poly, "", LINE, ["1", "l_quantity", "l_discount", "l_quantity*l_quantity", "l_quantity*l_discount", "l_discount*l_discount"], "lineitem", {"1": "one", "l_quantity": "q", "l_discount": "d", "l_quantity*l_quantity": "qq", "l_quantity*l_discount": "qd", "l_discount*l_discount": "dd"}))


@register("add_dummy_feature", "SELECT 1.0::DOUBLE AS dummy, l_orderkey, l_linenumber, l_tax FROM lineitem")
def _dummy(spark, sf_dir):
    return preprocess.add_dummy_feature(table(spark, sf_dir, "lineitem").select(*LINE, "l_tax"))


# --- missing values: orders whose price is below a bound count as missing ---

_GAPS = "SELECT o_orderkey, CASE WHEN o_totalprice >= 60000 THEN o_totalprice END AS price FROM orders"


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 60000, F.col("o_totalprice")).alias("price"))


for _strategy, _fill in {"mean": "avg(price)", "median": "quantile_cont(price, 0.5)", "most_frequent": "mode_low", "constant": "-1"}.items():
    _value = {"mode_low": "(SELECT price FROM t WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, price LIMIT 1)", "-1": "-1"}.get(_fill, f"(SELECT {_fill} FROM t)")
    register(f"simple_imputer_{_strategy}", f"WITH t AS ({_GAPS}) SELECT o_orderkey, round(coalesce(price, {_value}), 4) AS price FROM t", 4)(
        lambda spark, sf_dir, s=_strategy: preprocess.SimpleImputer(["price"], s, -1.0).fit_transform(_gaps(spark, sf_dir))
    )


@register("missing_indicator", f"WITH t AS ({_GAPS}) SELECT o_orderkey, CASE WHEN price IS NULL THEN 1 ELSE 0 END::INTEGER AS price_missing FROM t")
def _indicator(spark, sf_dir):
    return preprocess.MissingIndicator(["price"]).fit_transform(_gaps(spark, sf_dir)).select("o_orderkey", "price_missing")


# --- categories ---

register("ordinal_encoder", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer")(_applied(preprocess.OrdinalEncoder(["c_mktsegment"]), "", ["c_custkey"], ["c_mktsegment"], "customer"))
register("label_encoder", "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS event_type FROM events")(_applied(preprocess.LabelEncoder("event_type"), "", ["event_id"], ["event_type"], "events"))


@register(
    "one_hot_encoder",
    "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INTEGER AS flag_a, (l_returnflag = 'N')::INTEGER AS flag_n, (l_returnflag = 'R')::INTEGER AS flag_r FROM lineitem",
)
def _one_hot(spark, sf_dir):
    df = preprocess.OneHotEncoder(["l_returnflag"]).fit_transform(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag"))
    return df.select(*LINE, *[F.col(f"`l_returnflag={v}`").alias(f"flag_{v.lower()}") for v in "ANR"])


@register(
    "one_hot_encoder_infrequent",
    """WITH c AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority DESC) AS r FROM orders GROUP BY 1)
       SELECT o_orderkey, (r > 2)::INTEGER AS rare, (r <= 2)::INTEGER AS usual FROM orders JOIN c ON o_orderpriority = p""",
)
def _infrequent(spark, sf_dir):
    df = preprocess.OneHotEncoder(["o_orderpriority"], max_categories=3).fit_transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    rare = F.col("`o_orderpriority=infrequent`")
    usual = [F.col(f"`{c}`") for c in df.columns if c.startswith("o_orderpriority=") and not c.endswith("=infrequent")]
    return df.select("o_orderkey", rare.alias("rare"), sum(usual[1:], usual[0]).alias("usual"))


@register("label_binarizer", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS f, (o_orderstatus = 'O')::INTEGER AS o FROM orders")
def _binarized(spark, sf_dir):
    df = preprocess.LabelBinarizer("o_orderstatus").fit_transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    return df.select("o_orderkey", F.col("`o_orderstatus=F`").alias("f"), F.col("`o_orderstatus=O`").alias("o"))


@register("binary_encoder", "SELECT c_custkey, (((r >> 2) & 1))::INTEGER AS b0, ((r >> 1) & 1)::INTEGER AS b1, (r & 1)::INTEGER AS b2 FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS r FROM customer)")
def _bits(spark, sf_dir):
    df = preprocess.BinaryEncoder(["c_mktsegment"]).fit_transform(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    return df.select("c_custkey", *[F.col(f"c_mktsegment_{b}").alias(f"b{b}") for b in range(3)])


@register("multi_label_binarizer", "SELECT o_orderkey, (o_orderstatus = 'O' OR o_orderpriority = 'O')::INTEGER AS has_o, (o_orderpriority LIKE '1%')::INTEGER AS urgent FROM orders")
def _multi(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tags"))
    df = preprocess.MultiLabelBinarizer("tags").fit_transform(df)
    return df.select("o_orderkey", F.col("`tags=O`").alias("has_o"), F.col("`tags=1`").alias("urgent"))


for _smooth in ("auto", 10.0):
    _code = "coalesce(v * n / nullif(v * n + s, 0) * m + (1 - v * n / nullif(v * n + s, 0)) * g, g)" if _smooth == "auto" else "(n * m + 10.0 * g) / (n + 10.0)"
    register(
        f"target_encoder_{'auto' if _smooth == 'auto' else 'fixed'}",
        f"""WITH w AS (SELECT avg(o_totalprice) AS g, var_pop(o_totalprice) AS v FROM orders),
            c AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS s FROM orders GROUP BY 1)
            SELECT o_orderkey, round({_code}, 4) AS code FROM orders JOIN c ON o_orderpriority = p, w""",
        4,
    )(lambda spark, sf_dir, s=_smooth: preprocess.TargetEncoder("o_orderpriority", "o_totalprice", s, "code").fit_transform(table(spark, sf_dir, "orders")).select("o_orderkey", "code"))


@register("variance_threshold", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def _varying(spark, sf_dir):
    return preprocess.VarianceThreshold(FEATURES, 0.01).fit_transform(table(spark, sf_dir, "lineitem").select(*LINE, *FEATURES))


@register("column_transformer", "SELECT l_orderkey, l_linenumber, round(l_quantity / max(abs(l_quantity)) OVER (), 6) AS l_quantity, (l_tax > 0.04)::INTEGER::DOUBLE AS l_tax FROM lineitem")
def _columns_apart(spark, sf_dir):
    parts = preprocess.ColumnTransformer(preprocess.MaxAbsScaler(["l_quantity"]), preprocess.Binarizer(["l_tax"], 0.04), remainder="passthrough")
    return parts.fit(table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_tax")).transform(table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_tax"))


# --- text ---

_WORDS = "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1, 2"


@register("count_vectorizer_vocabulary", f"WITH c AS ({_WORDS}) SELECT term, count(*)::BIGINT AS df FROM c GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.8 * (SELECT count(*) FROM documents)")
def _vocabulary(spark, sf_dir):
    return text.CountVectorizer("doc_id", "text", min_df=3, max_df=0.8).fit(table(spark, sf_dir, "documents")).vocabulary


@register("count_vectorizer", f"WITH c AS ({_WORDS}) SELECT doc_id, term, n::BIGINT AS n FROM c WHERE term IN (SELECT term FROM c GROUP BY 1 HAVING count(*) >= 3)")
def _counts(spark, sf_dir):
    return text.CountVectorizer("doc_id", "text", min_df=3).fit_transform(table(spark, sf_dir, "documents"))


@register(
    "tfidf_vectorizer",
    f"""WITH c AS ({_WORDS}), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 3),
        w AS (SELECT doc_id, term, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS weight FROM c JOIN v USING (term))
        SELECT doc_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def _tfidf(spark, sf_dir):
    return text.TfidfVectorizer("doc_id", "text", min_df=3).fit_transform(table(spark, sf_dir, "documents"))


# --- feature scores ---


def _score_rows(spark, found: dict) -> DataFrame:
    return spark.createDataFrame([(c, float(v[0] if isinstance(v, tuple) else v)) for c, v in found.items()], "feature string, score double")


def _union(sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, " + sql.format(c=c) for c in FEATURES)


@register(
    "f_classif",
    _union(
        """(SELECT round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 4)
            FROM (SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY 1)) AS score"""
    ),
    4,
)
def _anova(spark, sf_dir):
    return _score_rows(spark, selection.f_classif(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag"))


@register(
    "chi2",
    _union("(SELECT round(sum((s - t * n / m) * (s - t * n / m) / (t * n / m)), 4) FROM (SELECT count(*) AS n, sum({c}) AS s, (SELECT sum({c}) FROM lineitem) AS t, (SELECT count(*) FROM lineitem) AS m FROM lineitem GROUP BY l_returnflag)) AS score"),
    4,
)
def _chi2(spark, sf_dir):
    return _score_rows(spark, selection.chi2(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag"))


@register("r_regression", _union("(SELECT round(corr({c}, l_extendedprice), 6) FROM lineitem) AS score"))
def _pearson(spark, sf_dir):
    return _score_rows(spark, selection.r_regression(table(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice"))


@register("f_regression", " UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 3) FROM lineitem) AS score" for c in FEATURES if c != "l_extendedprice"), 3)
def _f_regression(spark, sf_dir):
    return _score_rows(spark, selection.f_regression(table(spark, sf_dir, "lineitem"), [c for c in FEATURES if c != "l_extendedprice"], "l_extendedprice"))


@register("select_k_best", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _best(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select(*LINE, *columns, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("y"))
    return selection.Selector(columns, "y", "k_best", 1, "f_regression").fit_transform(df).drop("y")


# --- regression measures: the price against a rule ---

_PRED = "SELECT l_extendedprice / 1000.0 AS y, l_quantity * 1.5 + 1 AS p FROM lineitem"


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5 + 1).alias("p"))


_regression_sql = {
    "mean_absolute_error": "avg(abs(y - p))",
    "mean_squared_error": "avg((y - p) * (y - p))",
    "root_mean_squared_error": "sqrt(avg((y - p) * (y - p)))",
    "median_absolute_error": "quantile_cont(abs(y - p), 0.5)",
    "max_error": "max(abs(y - p))",
    "mean_absolute_percentage_error": "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))",
    "explained_variance_score": "1 - var_pop(y - p) / var_pop(y)",
    "r2_score": "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))",
    "mean_squared_log_error": "avg((ln(1 + y) - ln(1 + p)) ** 2)",
    "root_mean_squared_log_error": "sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2))",
    "mean_pinball_loss": "avg(CASE WHEN y >= p THEN 0.5 * (y - p) ELSE -0.5 * (y - p) END)",
    "mean_poisson_deviance": "avg(2 * (y * ln(y / p) - y + p))",
    "mean_gamma_deviance": "avg(2 * (ln(p / y) + y / p - 1))",
    "mean_tweedie_deviance": "avg(2 * (y ** 0.5 / (-0.5 * 0.5) - y * p ** (-0.5) / (-0.5) + p ** 0.5 / 0.5))",
}
for _name, _sql in _regression_sql.items():
    register(_name, f"WITH t AS ({_PRED}) SELECT round({_sql}, 5) AS {_name} FROM t", 5)(lambda spark, sf_dir, n=_name: metrics.regression_metric(_pred(spark, sf_dir), n, "y", "p"))
for _loss, _a in (("absolute", 0.5), ("pinball", 0.2)):
    _cost = "avg(CASE WHEN y >= {p} THEN " + f"{_a} * (y - {{p}}) ELSE {_a - 1} * (y - {{p}}) END)"
    register(f"d2_{_loss}_score", f"WITH t AS ({_PRED}), b AS (SELECT quantile_cont(y, {_a}) AS m FROM t) SELECT round(1 - {_cost.format(p='p')} / {_cost.format(p='m')}, 6) AS d2_{_loss} FROM t, b")(
        lambda spark, sf_dir, loss=_loss, a=_a: metrics.d2_score(_pred(spark, sf_dir), "y", "p", loss, a)
    )

# --- classification measures: the return flag against a rule on the discount ---

_CLASS = "SELECT l_returnflag AS y, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS p FROM lineitem"
_COUNTS = f"""t AS ({_CLASS}), l AS (SELECT y AS label FROM t UNION SELECT p FROM t),
  c AS (SELECT label, (SELECT count(*) FROM t WHERE y = label AND p = label)::DOUBLE AS tp, (SELECT count(*) FROM t WHERE y <> label AND p = label)::DOUBLE AS fp,
        (SELECT count(*) FROM t WHERE y = label AND p <> label)::DOUBLE AS fn, (SELECT count(*) FROM t WHERE y <> label AND p <> label)::DOUBLE AS tn FROM l)"""


def _classes(spark, sf_dir):
    rule = F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), rule.alias("p"))


_part = {"precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "fbeta": "2 * tp / nullif(2 * tp + fp + fn, 0)", "jaccard": "tp / nullif(tp + fp + fn, 0)"}
for _score, _sql in _part.items():
    for _average, _agg in (("macro", f"avg(coalesce({_sql}, 0))"), ("weighted", f"sum(coalesce({_sql}, 0) * (tp + fn)) / sum(tp + fn)"), ("micro", _sql.replace("tp", "sum(tp)").replace("fp", "sum(fp)").replace("fn", "sum(fn)"))):
        register(f"{_score}_{_average}", f"WITH {_COUNTS} SELECT round({_agg}, 6) AS {_score} FROM c")(lambda spark, sf_dir, s=_score, a=_average: metrics.averaged_score(_classes(spark, sf_dir), "y", "p", s, a))

_class_queries = {
    "accuracy_score": ("SELECT round(avg((y = p)::INTEGER), 6) AS accuracy FROM t", metrics.accuracy_score),
    "zero_one_loss": ("SELECT round(avg((y <> p)::INTEGER), 6) AS zero_one_loss FROM t", metrics.zero_one_loss),
    "hamming_loss": ("SELECT round(avg((y <> p)::INTEGER), 6) AS zero_one_loss FROM t", metrics.zero_one_loss),
    "balanced_accuracy_score": ("SELECT round(avg(tp / (tp + fn)), 6) AS balanced_accuracy FROM c", metrics.balanced_accuracy_score),
    "matthews_corrcoef": ("SELECT round((sum(tp) * sum(tp + fn) - sum((tp + fn) * (tp + fp))) / (sqrt(sum(tp + fn) ** 2 - sum((tp + fp) ** 2)) * sqrt(sum(tp + fn) ** 2 - sum((tp + fn) ** 2))), 6) AS mcc FROM c", metrics.matthews_corrcoef),
    "cohen_kappa_score": ("SELECT round((sum(tp) / sum(tp + fn) - sum((tp + fn) * (tp + fp)) / sum(tp + fn) ** 2) / (1 - sum((tp + fn) * (tp + fp)) / sum(tp + fn) ** 2), 6) AS kappa FROM c", metrics.cohen_kappa_score),
    "confusion_matrix": ("SELECT y AS y_true, p AS y_pred, count(*)::BIGINT AS n FROM t GROUP BY 1, 2", metrics.confusion_matrix),
    "multilabel_confusion_matrix": ("SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, (tp + fn)::BIGINT AS support FROM c", metrics.class_counts),
    "precision_recall_fscore_support": ("SELECT label, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS fbeta, round(tp / (tp + fp + fn), 6) AS jaccard, (tp + fn)::BIGINT AS support FROM c", metrics.class_scores),
}
for _name, (_sql, _f) in _class_queries.items():
    register(_name, f"WITH {_COUNTS} {_sql}")(lambda spark, sf_dir, f=_f: f(_classes(spark, sf_dir), "y", "p"))

# --- measures of a score: is the item returned, by its discount ---

_SCORE = "SELECT (l_returnflag = 'R')::INTEGER AS y, round(l_discount * 10, 2) AS s, (l_tax > 0.04)::INTEGER AS p FROM lineitem"
_RUN = f"""t AS ({_SCORE}), g AS (SELECT s, sum(y) AS a, sum(1 - y) AS b FROM t GROUP BY 1),
  r AS (SELECT s AS threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, (SELECT sum(a) FROM g) AS pos, (SELECT sum(b) FROM g) AS neg FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_discount") * 10, 2).alias("s"), (F.col("l_tax") > 0.04).cast("int").alias("p"))


_score_queries = {
    "roc_auc_score": ("SELECT round(sum(a * (coalesce((SELECT sum(b) FROM g h WHERE h.s < g.s), 0) + b / 2.0)) / (sum(a) * sum(b)), 6) AS roc_auc FROM g", metrics.roc_auc_score),
    "confusion_matrix_at_thresholds": ("SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, (neg - fp)::BIGINT AS tn FROM r", metrics.threshold_counts),
    "precision_recall_curve": ("SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM r", metrics.precision_recall_curve),
    "det_curve": ("SELECT threshold, round(fp / neg, 6) AS fpr, round((pos - tp) / pos, 6) AS fnr FROM r", metrics.det_curve),
    "average_precision_score": ("SELECT round(sum((tp - before) / pos * tp / (tp + fp)), 6) AS average_precision FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS before FROM r)", metrics.average_precision_score),
    "log_loss": ("SELECT round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM (SELECT y, least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM t)", metrics.log_loss),
    "brier_score_loss": ("SELECT round(avg((s - y) ** 2), 6) AS brier FROM t", metrics.brier_score_loss),
    "hinge_loss": ("SELECT round(avg(greatest(0, 1 - (2 * y - 1) * s)), 6) AS hinge FROM t", metrics.hinge_loss),
    "calibration_curve": ("SELECT least(floor(s * 5), 4)::INTEGER AS bin, round(avg(s), 6) AS prob_pred, round(avg(y), 6) AS prob_true FROM t GROUP BY 1", metrics.calibration_curve),
}
for _name, (_sql, _f) in _score_queries.items():
    register(_name, f"WITH {_RUN} {_sql}")(lambda spark, sf_dir, f=_f: f(_scores(spark, sf_dir), "y", "s"))
register("class_likelihood_ratios", f"WITH t AS ({_SCORE}) SELECT round((sum(y * p) / sum(y)) / (sum((1 - y) * p) / sum(1 - y)), 6) AS positive, round((sum(y * (1 - p)) / sum(y)) / (sum((1 - y) * (1 - p)) / sum(1 - y)), 6) AS negative FROM t")(
    lambda spark, sf_dir: metrics.class_likelihood_ratios(_scores(spark, sf_dir), "y", "p")
)
register(
    "roc_curve",
    f"""WITH {_RUN}, x AS (SELECT threshold, tp, fp, pos, neg FROM r UNION ALL SELECT 'inf'::DOUBLE, 0, 0, max(pos), max(neg) FROM r),
        d AS (SELECT *, tp - lag(tp) OVER w AS a, fp - lag(fp) OVER w AS b, lead(tp) OVER w - tp AS c, lead(fp) OVER w - fp AS e FROM x WINDOW w AS (ORDER BY threshold DESC))
        SELECT threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM d WHERE coalesce(a <> c OR b <> e, true)""",
)(lambda spark, sf_dir: metrics.roc_curve(_scores(spark, sf_dir), "y", "s"))

# --- agreement of labelings of orders ---

_LABELS = """t AS (SELECT o_orderpriority AS a, CASE WHEN o_totalprice < 100000 THEN 'l' WHEN o_totalprice < 250000 THEN 'm' ELSE 'h' END AS b FROM orders),
  m AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM m GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM m GROUP BY 1),
  z AS (SELECT (SELECT sum(n) FROM m) AS n, (SELECT sum(n * n) FROM m) AS cc, (SELECT sum(na * na) FROM ra) AS aa, (SELECT sum(nb * nb) FROM rb) AS bb,
        (SELECT sum(m.n / s.n * ln(m.n * s.n / (na * nb))) FROM m JOIN ra USING (a) JOIN rb USING (b), (SELECT sum(n) AS n FROM m) s) AS mi,
        (SELECT -sum(na / s.n * ln(na / s.n)) FROM ra, (SELECT sum(n) AS n FROM m) s) AS ha, (SELECT -sum(nb / s.n * ln(nb / s.n)) FROM rb, (SELECT sum(n) AS n FROM m) s) AS hb)"""


def _labelings(spark, sf_dir):
    b = F.when(F.col("o_totalprice") < 100000, "l").when(F.col("o_totalprice") < 250000, "m").otherwise("h")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), b.alias("b"))


_agreement_sql = {
    "rand_score": "(n * (n - 1) / 2 + (cc - n) - (aa - n) / 2 - (bb - n) / 2) / (n * (n - 1) / 2)",
    "adjusted_rand_score": "((cc - n) / 2 - (aa - n) * (bb - n) / 4 / (n * (n - 1) / 2)) / ((aa + bb - 2 * n) / 4 - (aa - n) * (bb - n) / 4 / (n * (n - 1) / 2))",
    "mutual_info_score": "mi",
    "normalized_mutual_info_score": "mi / ((ha + hb) / 2)",
    "homogeneity_score": "mi / ha",
    "completeness_score": "mi / hb",
    "v_measure_score": "2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)",
    "fowlkes_mallows_score": "((cc - n) / 2) / (sqrt((aa - n) / 2) * sqrt((bb - n) / 2))",
}
for _name, _sql in _agreement_sql.items():
    register(_name, f"WITH {_LABELS} SELECT round({_sql}, 7) + 0.0 AS {_name} FROM z", 7)(lambda spark, sf_dir, n=_name: metrics.clustering_metric(_labelings(spark, sf_dir), n, "a", "b"))
register("contingency_matrix", f"WITH {_LABELS} SELECT a, b, n::BIGINT AS n FROM m")(lambda spark, sf_dir: metrics.contingency_matrix(_labelings(spark, sf_dir), "a", "b"))
register("pair_confusion_matrix", f"WITH {_LABELS} SELECT n * n - aa - bb + cc AS apart_apart, bb - cc AS apart_together, aa - cc AS together_apart, cc - n AS together_together FROM z")(lambda spark, sf_dir: metrics.pair_confusion_matrix(_labelings(spark, sf_dir), "a", "b"))

# --- rankings of the lines of an order ---

_RANK = "t AS (SELECT l_orderkey AS q, l_quantity AS gain, (l_returnflag = 'R')::INTEGER AS rel, l_discount AS s FROM lineitem)"


def _rankings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_quantity").alias("gain"), (F.col("l_returnflag") == "R").cast("int").alias("rel"), F.col("l_discount").alias("s"))


_DCG = """d AS (SELECT q, sum(part) AS dcg FROM (SELECT q, s, avg(gain) * sum(1 / log2(r + 1)) AS part FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC) AS r FROM t) GROUP BY 1, 2) GROUP BY 1),
  i AS (SELECT q, sum(gain / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gain DESC) AS r FROM t) GROUP BY 1)"""
_rank_queries = {
    "dcg_score": (f"{_DCG} SELECT round(avg(dcg), 5) AS dcg FROM d", lambda df: metrics.dcg_score(df, "q", "gain", "s")),
    "ndcg_score": (f"{_DCG} SELECT round(avg(dcg / ideal), 5) AS ndcg FROM d JOIN i USING (q)", lambda df: metrics.dcg_score(df, "q", "gain", "s", normalise=True)),
    "coverage_error": ("e AS (SELECT q, min(CASE WHEN rel = 1 THEN s END) AS m FROM t GROUP BY 1) SELECT round(avg(far), 5) AS coverage_error FROM (SELECT q, coalesce(sum((s >= m)::INTEGER), 0) AS far FROM t JOIN e USING (q) GROUP BY 1)", lambda df: metrics.coverage_error(df, "q", "rel", "s")),
    "label_ranking_average_precision_score": (
        "e AS (SELECT q, rel, sum(rel) OVER w / count(*) OVER w AS part FROM t WINDOW w AS (PARTITION BY q ORDER BY s DESC RANGE UNBOUNDED PRECEDING)) SELECT round(avg(p), 5) AS lrap FROM (SELECT CASE WHEN min(rel) = max(rel) THEN 1.0 ELSE avg(CASE WHEN rel = 1 THEN part END) END AS p FROM e GROUP BY q)",
        lambda df: metrics.label_ranking_average_precision_score(df, "q", "rel", "s"),
    ),
    "label_ranking_loss": (
        "e AS (SELECT q, rel, sum(1 - rel) OVER w AS wrong FROM t WINDOW w AS (PARTITION BY q ORDER BY s DESC RANGE UNBOUNDED PRECEDING)) SELECT round(avg(p), 5) AS ranking_loss FROM (SELECT coalesce(sum(rel * wrong) / nullif(sum(rel) * sum(1 - rel), 0), 0) AS p FROM e GROUP BY q)",
        lambda df: metrics.label_ranking_loss(df, "q", "rel", "s"),
    ),
}
for _name, (_sql, _f) in _rank_queries.items():
    register(_name, f"WITH {_RANK}, {_sql}", 5)(lambda spark, sf_dir, f=_f: f(_rankings(spark, sf_dir)))

# --- distances and kernels of embeddings to the mean of each label ---

_MEANS = """m AS (SELECT label AS b, list(v ORDER BY i) AS vb FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  e AS (SELECT vec_id AS a, embedding::DOUBLE[] AS va FROM embeddings)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast(ArrayType(DoubleType())).alias("v"), "label")
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", F.col("v.x").alias("v"))
    return rows.select(F.col("vec_id").alias("key"), "v"), means.select(F.col("label").alias("key"), "v")


_pair_sql = {
    "euclidean": ("list_distance(va, vb)", False),
    "manhattan": ("list_sum(list_transform(list_zip(va, vb), lambda x: abs(x[1] - x[2])))", False),
    "chebyshev": ("list_max(list_transform(list_zip(va, vb), lambda x: abs(x[1] - x[2])))", False),
    "cosine": ("1 - list_cosine_similarity(va, vb)", False),
    "linear": ("list_inner_product(va, vb)", True),
    "rbf": ("exp(-0.1 * list_distance(va, vb) ** 2)", True),
    "polynomial": ("(0.1 * list_inner_product(va, vb) + 1) ** 3", True),
    "sigmoid": ("tanh(0.1 * list_inner_product(va, vb) + 1)", True),
    "laplacian": ("exp(-0.1 * list_sum(list_transform(list_zip(va, vb), lambda x: abs(x[1] - x[2]))))", True),
}
for _name, (_sql, _kernel) in _pair_sql.items():
    register(f"{_name}_{'kernel' if _kernel else 'distances'}", f"WITH {_MEANS} SELECT a, b, round({_sql}, 5) + 0.0 AS {_name} FROM e, m", 5)(
        lambda spark, sf_dir, n=_name, k=_kernel: pairwise.pairwise(*_vectors(spark, sf_dir), "key", "v", n, k, **({"gamma": 0.1} if k else {}))
    )
register("pairwise_distances_argmin_min", f"WITH {_MEANS} SELECT a, b, round(d, 5) AS distance, 0::INTEGER AS rank FROM (SELECT a, b, list_distance(va, vb) AS d, row_number() OVER (PARTITION BY a ORDER BY list_distance(va, vb), b) AS r FROM e, m) WHERE r = 1", 5)(
    lambda spark, sf_dir: pairwise.nearest(*_vectors(spark, sf_dir), "key", "v")
)
register("nearest_neighbors_k3", f"WITH {_MEANS} SELECT a, b, round(d, 5) AS distance, (r - 1)::INTEGER AS rank FROM (SELECT a, b, list_distance(va, vb) AS d, row_number() OVER (PARTITION BY a ORDER BY list_distance(va, vb), b) AS r FROM e, m) WHERE r <= 3", 5)(
    lambda spark, sf_dir: pairwise.nearest(*_vectors(spark, sf_dir), "key", "v", 3)
)


# --- neighbours among all embeddings of those whose vec_id is divisible by 100 ---


def _neighbors_among_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast(ArrayType(DoubleType())).alias("v"))
    return pairwise.nearest(rows.where("key % 100 = 0"), rows, "key", "v", 3)


register(
    "nearest_neighbors_k3_embeddings",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_distance(x.v, y.v) AS d FROM e x, e y WHERE x.vec_id % 100 = 0)
        SELECT a, b, round(d, 5) AS distance, (r - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) WHERE r <= 3""",
    5,
)(_neighbors_among_embeddings)

# --- row-aligned distances: an embedding and the mean of its label ---


def _aligned(spark, sf_dir):
    rows, means = _vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    means = means.select(F.col("key").alias("label"), F.col("v").alias("m"))
    return rows.join(labels, "key").join(means, "label").select("key", "v", "m")


for _name in ("euclidean", "manhattan", "cosine", "chebyshev"):
    register(f"paired_{_name}_distances", f"WITH {_MEANS} SELECT a AS key, round({_pair_sql[_name][0]}, 5) + 0.0 AS {_name} FROM e JOIN embeddings x ON x.vec_id = e.a JOIN m ON m.b = x.label", 5)(
        lambda spark, sf_dir, n=_name: pairwise.paired(_aligned(spark, sf_dir), "v", "m", n).select("key", n)
    )
register("cosine_similarity", f"WITH {_MEANS} SELECT a, b, round(list_cosine_similarity(va, vb), 5) + 0.0 AS cosine FROM e, m", 5)(lambda spark, sf_dir: pairwise.pairwise(*_vectors(spark, sf_dir), "key", "v", "cosine", True))
register("sqeuclidean_distances", f"WITH {_MEANS} SELECT a, b, round(list_distance(va, vb) ** 2, 4) + 0.0 AS sqeuclidean FROM e, m", 4)(lambda spark, sf_dir: pairwise.pairwise(*_vectors(spark, sf_dir), "key", "v", "sqeuclidean"))

_PAIR = "SELECT o_orderkey, o_totalprice / 500000.0 AS p, (o_custkey % 100) / 100.0 AS q FROM orders"


def _angles(spark, sf_dir):
    p, q = F.col("o_totalprice") / 500000.0, F.pmod("o_custkey", F.lit(100)) / 100.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array(p, q).alias("v"), F.array(q, p).alias("w"))


register("haversine_distances", f"WITH t AS ({_PAIR}) SELECT o_orderkey, round(2 * asin(sqrt(sin((p - q) / 2) ** 2 + cos(p) * cos(q) * sin((q - p) / 2) ** 2)), 6) AS haversine FROM t")(lambda spark, sf_dir: pairwise.paired(_angles(spark, sf_dir), "v", "w", "haversine").select("o_orderkey", "haversine"))
register("additive_chi2_kernel", f"WITH t AS ({_PAIR}) SELECT o_orderkey, round(-2 * coalesce((p - q) ** 2 / nullif(p + q, 0), 0), 6) + 0.0 AS additive_chi2 FROM t")(lambda spark, sf_dir: pairwise.paired(_angles(spark, sf_dir), "v", "w", "additive_chi2").select("o_orderkey", "additive_chi2"))
register("chi2_kernel", f"WITH t AS ({_PAIR}) SELECT o_orderkey, round(exp(-2 * coalesce((p - q) ** 2 / nullif(p + q, 0), 0)), 6) + 0.0 AS chi2 FROM t")(lambda spark, sf_dir: pairwise.paired(_angles(spark, sf_dir), "v", "w", "chi2").select("o_orderkey", "chi2"))

# --- spread of clusters: lineitem by return flag ---

_XC = "SELECT l_returnflag AS k, l_quantity AS x, l_discount AS y FROM lineitem"
register(
    "calinski_harabasz_score",
    f"""WITH t AS ({_XC}), w AS (SELECT sum(c * v) AS within, count(*) AS k FROM (SELECT count(*) AS c, var_pop(x) + var_pop(y) AS v FROM t GROUP BY k)),
        a AS (SELECT count(*) AS n, count(*) * (var_pop(x) + var_pop(y)) AS total FROM t) SELECT round((total - within) / (k - 1) / (within / (n - k)), 4) AS calinski_harabasz FROM a, w""",
    4,
)(lambda spark, sf_dir: metrics.calinski_harabasz_score(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))
register(
    "davies_bouldin_score",
    f"""WITH t AS ({_XC}), m AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM t GROUP BY 1), s AS (SELECT k, mx, my, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s FROM t JOIN m USING (k) GROUP BY 1, 2, 3)
        SELECT round(avg(worst), 2) AS davies_bouldin FROM (SELECT a.k, max((a.s + b.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS worst FROM s a JOIN s b ON a.k <> b.k GROUP BY 1)""",
    2,
)(lambda spark, sf_dir: metrics.davies_bouldin_score(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))

# --- maps by distribution ---

register("power_transformer", None)(_applied(quantile.PowerTransformer(["l_quantity", "l_extendedprice"]), "", LINE, ["l_quantity", "l_extendedprice"], "lineitem"))
_QUANTILES = "(SELECT quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem)"
register(
    "quantile_transformer",
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN x <= q[1] THEN 0 WHEN x >= q[5] THEN 1 WHEN x < q[2] THEN (x - q[1]) / (q[2] - q[1]) / 4 WHEN x < q[3] THEN 0.25 + (x - q[2]) / (q[3] - q[2]) / 4
        WHEN x < q[4] THEN 0.5 + (x - q[3]) / (q[4] - q[3]) / 4 ELSE 0.75 + (x - q[4]) / (q[5] - q[4]) / 4 END, 6) AS l_extendedprice FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem), {_QUANTILES}""",
)(_applied(quantile.QuantileTransformer(["l_extendedprice"], 5), "", LINE, ["l_extendedprice"], "lineitem"))

# --- splits of orders ---

_N = "(SELECT count(*) FROM orders)"
register("k_fold", f"SELECT o_orderkey, CASE WHEN r < ({_N} % 7) * ({_N} // 7 + 1) THEN r // ({_N} // 7 + 1) ELSE (r - {_N} % 7) // ({_N} // 7) END::INTEGER AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)")(
    lambda spark, sf_dir: splits.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)
)
register("leave_one_group_out", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS fold FROM orders")(lambda spark, sf_dir: splits.leave_one_group_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "fold"))
register(
    "time_series_split",
    f"""SELECT o_orderkey, split::INTEGER AS split, part FROM (SELECT o_orderkey, split, CASE WHEN r >= {_N} - (4 - split) * ({_N} // 5) AND r < {_N} - (3 - split) * ({_N} // 5) THEN 'test' WHEN r < {_N} - (4 - split) * ({_N} // 5) - 10 THEN 'train' END AS part
        FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders), (SELECT unnest([0, 1, 2, 3]) AS split)) WHERE part IS NOT NULL""",
)(lambda spark, sf_dir: splits.time_series_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 4, 10).select("o_orderkey", "split", "part"))
register("predefined_split", "SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END)::INTEGER AS fold FROM orders")(
    lambda spark, sf_dir: splits.predefined_split(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 8).otherwise(-1).alias("given")), "given").select("o_orderkey", "fold")
)
register("group_k_fold", None)(lambda spark, sf_dir: splits.group_k_fold(table(spark, sf_dir, "orders"), "o_orderpriority", 3).groupBy("fold").agg(F.count("*").alias("n")))
register(
    "stratified_k_fold",
    """WITH c AS (SELECT o_orderstatus AS k, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*) AS s FROM orders GROUP BY 1),
        e AS (SELECT k, f, sum((s + n - 1 - f + 5) // 5 - (s - 1 - f + 5) // 5) OVER (PARTITION BY k ORDER BY f) AS ends FROM c, (SELECT unnest([0, 1, 2, 3, 4]) AS f)),
        r AS (SELECT o_orderkey, o_orderstatus AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place FROM orders)
        SELECT o_orderkey, count(*) FILTER (place >= ends)::INTEGER AS fold FROM r JOIN e USING (k) GROUP BY 1""",
)(lambda spark, sf_dir: splits.stratified_k_fold(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus", 5).select("o_orderkey", "fold"))
register("train_test_split", None)(lambda spark, sf_dir: splits.train_test_split(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.2, 7).select("o_orderkey", "part"))

# --- linear models ---


def _coefficients(spark, model) -> DataFrame:
    rows = [("intercept", model.intercept), *zip(model.columns, model.coefficients.tolist(), strict=True)]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "name string, weight double")


_XY = "SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n, var_pop(l_quantity) AS sxx, covar_pop(l_quantity, l_extendedprice) AS sxy FROM lineitem"
_one_x = {
    "linear_regression": (linear.LinearRegression(["l_quantity"], "l_extendedprice"), "sxy / sxx"),
    "ridge": (linear.Ridge(["l_quantity"], "l_extendedprice", alpha=1000.0), "n * sxy / (n * sxx + 1000)"),
    "lasso": (linear.Lasso(["l_quantity"], "l_extendedprice", alpha=1000.0), "sign(sxy) * greatest(abs(sxy) - 1000, 0) / sxx"),
    "elastic_net": (linear.ElasticNet(["l_quantity"], "l_extendedprice", alpha=100.0, l1_ratio=0.5), "sign(sxy) * greatest(abs(sxy) - 50, 0) / (sxx + 50)"),
    "orthogonal_matching_pursuit": (linear.OrthogonalMatchingPursuit(["l_quantity"], "l_extendedprice"), "sxy / sxx"),
}
for _name, (_op, _b) in _one_x.items():
    register(_name, f"WITH s AS ({_XY}) SELECT 'l_quantity' AS name, round({_b}, 4) AS weight FROM s UNION ALL SELECT 'intercept', round(my - mx * ({_b}), 4) FROM s", 4)(lambda spark, sf_dir, op=_op: _coefficients(spark, op.fit(table(spark, sf_dir, "lineitem"))))
register(
    "linear_regression_two_features",
    """WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_tax) AS mb, avg(l_extendedprice) AS my, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab,
        covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS yb FROM lineitem), c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS a, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM s)
        SELECT 'l_quantity' AS name, round(a, 3) AS weight FROM c UNION ALL SELECT 'l_tax', round(b, 3) FROM c UNION ALL SELECT 'intercept', round(my - a * ma - b * mb, 3) FROM c""",
    3,
)(lambda spark, sf_dir: _coefficients(spark, linear.LinearRegression(["l_quantity", "l_tax"], "l_extendedprice").fit(table(spark, sf_dir, "lineitem"))))
register("linear_regression_predict", f"WITH s AS ({_XY}) SELECT l_orderkey, l_linenumber, round(my + sxy / sxx * (l_quantity - mx), 3) AS prediction FROM lineitem, s", 3)(
    lambda spark, sf_dir: linear.LinearRegression(["l_quantity"], "l_extendedprice").fit_transform(table(spark, sf_dir, "lineitem")).select(*LINE, "prediction")
)
for _name, _op in {"bayesian_ridge": linear.BayesianRidge(["l_quantity", "l_tax"], "l_extendedprice"), "huber_regressor": linear.HuberRegressor(["l_quantity", "l_tax"], "l_extendedprice")}.items():
    register(_name, None)(lambda spark, sf_dir, op=_op: _coefficients(spark, op.fit(table(spark, sf_dir, "lineitem"))))
register("logistic_regression", None)(
    lambda spark, sf_dir: _coefficients(spark, linear.LogisticRegression(["l_quantity", "l_discount"], "y").fit(table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50000).cast("double"))))
)
register("dummy_regressor_median", "SELECT o_orderkey, round((SELECT quantile_cont(o_totalprice, 0.5) FROM orders), 4) AS prediction FROM orders", 4)(lambda spark, sf_dir: dummy.DummyRegressor("o_totalprice", "median").fit_transform(table(spark, sf_dir, "orders")).select("o_orderkey", "prediction"))
register("dummy_classifier", "SELECT o_orderkey, (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM orders")(lambda spark, sf_dir: dummy.DummyClassifier("o_orderstatus").fit_transform(table(spark, sf_dir, "orders")).select("o_orderkey", "prediction"))

# --- naive Bayes and centroids ---

_BY = "SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS ma, var_pop(l_quantity) AS va, avg(l_extendedprice) AS mb, var_pop(l_extendedprice) AS vb FROM lineitem GROUP BY 1"
_scored = {
    "gaussian_nb": (bayes.GaussianNB(["l_quantity", "l_extendedprice"], "l_returnflag"), "ln(n / (SELECT count(*) FROM lineitem)) - 0.5 * ln(2 * pi() * (va + f)) - (l_quantity - ma) ** 2 / (2 * (va + f)) - 0.5 * ln(2 * pi() * (vb + f)) - (l_extendedprice - mb) ** 2 / (2 * (vb + f))"),
    "nearest_centroid": (bayes.NearestCentroid(["l_quantity", "l_extendedprice"], "l_returnflag"), "-((l_quantity - ma) ** 2 + (l_extendedprice - mb) ** 2)"),
}
for _name, (_op, _sql) in _scored.items():
    register(
        _name,
        f"""WITH c AS ({_BY}), f AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_extendedprice)) AS f FROM lineitem)
            SELECT l_orderkey, l_linenumber, prediction FROM (SELECT l_orderkey, l_linenumber, k AS prediction, row_number() OVER (PARTITION BY line ORDER BY {_sql} DESC, k) AS r FROM (SELECT *, row_number() OVER () AS line FROM lineitem), c, f) WHERE r = 1""",
    )(lambda spark, sf_dir, op=_op: op.fit_transform(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", *FEATURES)).select(*LINE, "prediction"))
_sums = ", ".join(f"sum({c}) AS s{i}, count(*) FILTER ({c} > 0) AS b{i}" for i, c in enumerate(FEATURES))
_own, _all = " + ".join(f"s{i}" for i in range(4)), " + ".join(f"t{i}" for i in range(4))
_bayes = {
    "multinomial_nb": (bayes.MultinomialNB, "ln(n / tn) + " + " + ".join(f"{c} * ln((s{i} + 1) / ({_own} + 4))" for i, c in enumerate(FEATURES))),
    "complement_nb": (bayes.ComplementNB, " - ".join(["0", *[f"{c} * ln((t{i} - s{i} + 1) / ({_all} - ({_own}) + 4))" for i, c in enumerate(FEATURES)]])),
    "bernoulli_nb": (bayes.BernoulliNB, "ln(n / tn) + " + " + ".join(f"CASE WHEN {c} > 0 THEN ln((b{i} + 1) / (n + 2)) ELSE ln(1 - (b{i} + 1) / (n + 2)) END" for i, c in enumerate(FEATURES))),
}
for _name, (_kind, _sql) in _bayes.items():
    register(
        _name,
        f"""WITH c AS (SELECT l_returnflag AS k, count(*) AS n, {_sums} FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS tn, {", ".join(f"sum(s{i}) AS t{i}" for i in range(4))} FROM c)
            SELECT l_orderkey, l_linenumber, prediction FROM (SELECT l_orderkey, l_linenumber, k AS prediction, row_number() OVER (PARTITION BY line ORDER BY {_sql} DESC, k) AS r
            FROM (SELECT *, row_number() OVER () AS line FROM lineitem), c, t) WHERE r = 1""",
    )(lambda spark, sf_dir, kind=_kind: kind(FEATURES, "l_returnflag").fit_transform(table(spark, sf_dir, "lineitem")).select(*LINE, "prediction"))

# --- covariance, components, clusters ---

_TRIPLES = [(a, b) for a in ("l_quantity", "l_discount") for b in ("l_quantity", "l_discount")]


def _covariance(spark, fitted) -> DataFrame:
    rows = [(a, b, float(fitted.covariance[i, j])) for i, a in enumerate(fitted.columns) for j, b in enumerate(fitted.columns)]
    return spark.createDataFrame(rows, "a string, b string, covariance double")


register("empirical_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 6) + 0.0 AS covariance FROM lineitem" for a, b in _TRIPLES))(
    lambda spark, sf_dir: _covariance(spark, decomposition.EmpiricalCovariance(["l_quantity", "l_discount"]).fit(table(spark, sf_dir, "lineitem")))
)
register("shrunk_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(0.9 * covar_pop({a}, {b}) + {0.1 if a == b else 0.0} * (var_pop(l_quantity) + var_pop(l_discount)) / 2, 6) + 0.0 AS covariance FROM lineitem" for a, b in _TRIPLES))(
    lambda spark, sf_dir: _covariance(spark, decomposition.ShrunkCovariance(["l_quantity", "l_discount"]).fit(table(spark, sf_dir, "lineitem")))
)
register("ledoit_wolf", None)(lambda spark, sf_dir: _covariance(spark, decomposition.LedoitWolf(FEATURES).fit(table(spark, sf_dir, "lineitem"))))
register(
    "pca",
    """WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b, var_samp(l_extendedprice) AS d FROM lineitem),
       e AS (SELECT *, (a + d) / 2 + sqrt((a - d) ** 2 / 4 + b * b) AS l FROM s), v AS (SELECT *, b / sqrt(b * b + (l - a) ** 2) AS x, (l - a) / sqrt(b * b + (l - a) ** 2) AS y FROM e)
       SELECT l_orderkey, l_linenumber, round(CASE WHEN (abs(x) >= abs(y) AND x < 0) OR (abs(y) > abs(x) AND y < 0) THEN -1 ELSE 1 END * ((l_quantity - ma) * x + (l_extendedprice - mb) * y), 3) + 0.0 AS pc1 FROM lineitem, v""",
    3,
)(lambda spark, sf_dir: decomposition.PCA(["l_quantity", "l_extendedprice"], 1).fit_transform(table(spark, sf_dir, "lineitem")).select(*LINE, "pc1"))
register("k_means", None)(lambda spark, sf_dir: decomposition.KMeans(["l_quantity", "l_discount"], 4, max_iter=20).fit_transform(table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_discount")).select(*LINE, "cluster"))

# --- events in windows ---

register("windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", 4)(lambda spark, sf_dir: windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]))


def scaled_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: standard scores of lineitem's columns, and the price predicted from the others."""
    df = table(spark, sf_dir, "lineitem").select(*LINE, *FEATURES)
    columns = [c for c in FEATURES if c != "l_extendedprice"]
    df = preprocess.StandardScaler(columns).fit_transform(df)
    return rounded(linear.LinearRegression(columns, "l_extendedprice").fit_transform(df), 4)


from tessera.plans import learning  # noqa: E402, F401  registers its queries here
