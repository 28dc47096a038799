"""Scores of predictions, rankings and clusterings, each one row (or a small table) from few aggregations.

Ratios without a denominator are 0 where not said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_quantiles, neighbours, running

_EPS = 2.0**-52


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# --- regression: aggregate expressions over y (true) and p (predicted) ---


def regression_expressions(y: Column, p: Column, alpha: float = 0.5, power: float = 1.5) -> dict[str, Column]:
    """All measures that one pass can take, by name; the median of errors takes several."""
    e = y - p
    pinball = F.when(e >= 0, alpha * e).otherwise((alpha - 1) * e)
    tweedie = 2 * (y ** F.lit(2 - power) / ((1 - power) * (2 - power)) - y * p ** F.lit(1 - power) / (1 - power) + p ** F.lit(2 - power) / (2 - power))
    spread = F.var_pop(y) * F.count(y)
    return {
        "mean_absolute_error": F.avg(F.abs(e)),
        "mean_squared_error": F.avg(e * e),
        "root_mean_squared_error": F.sqrt(F.avg(e * e)),
        "max_error": F.max(F.abs(e)),
        "mean_absolute_percentage_error": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(_EPS))),
        "explained_variance_score": F.when(spread == 0, F.when(F.var_pop(e) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.var_pop(e), F.var_pop(y))),
        "r2_score": F.when(spread == 0, F.when(F.sum(e * e) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.sum(e * e), spread)),
        "mean_squared_log_error": F.avg((F.log1p(y) - F.log1p(p)) ** 2),
        "root_mean_squared_log_error": F.sqrt(F.avg((F.log1p(y) - F.log1p(p)) ** 2)),
        "mean_pinball_loss": F.avg(pinball),
        "mean_poisson_deviance": F.avg(2 * (F.when(y > 0, y * F.ln(y / p)).otherwise(0.0) - y + p)),
        "mean_gamma_deviance": F.avg(2 * (F.ln(p / y) + y / p - 1)),
        "mean_tweedie_deviance": F.avg(tweedie),
    }


def regression_metric(df: DataFrame, name: str, y: str, p: str, **options) -> DataFrame:
    if name == "median_absolute_error":
        [[middle]] = exact_quantiles(df, [F.abs(F.col(y).cast("double") - F.col(p).cast("double"))], [0.5])
        return df.sparkSession.createDataFrame([(middle,)], f"{name} double")
    return df.agg(regression_expressions(F.col(y).cast("double"), F.col(p).cast("double"), **options)[name].alias(name))


def d2_score(df: DataFrame, y: str, p: str, loss: str = "absolute", alpha: float = 0.5) -> DataFrame:
    """1 - loss / loss of the best constant: the median for absolute error, the quantile alpha for pinball loss."""
    y_, p_ = F.col(y).cast("double"), F.col(p).cast("double")
    a = 0.5 if loss == "absolute" else alpha
    [[best]] = exact_quantiles(df, [y_], [a])
    cost = lambda e: F.avg(F.when(e >= 0, a * e).otherwise((a - 1) * e))
    return df.agg((1 - F.try_divide(cost(y_ - p_), cost(y_ - F.lit(best).cast("double")))).alias(f"d2_{loss}"))


# --- classification ---


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """y_true, y_pred and n of every pair that occurs: the table that the label measures start from."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, tp, fp, fn, tn and support of every label."""
    m = confusion_matrix(df, y, p)
    sides = m.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(True).alias("t")), F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("t")))).alias("s"), "y_true", "y_pred", "n")
    hit = F.col("y_true") == F.col("y_pred")
    per = sides.groupBy("s.label").agg(
        F.sum(F.when(hit & F.col("s.t"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & ~F.col("s.t"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & F.col("s.t"), F.col("n")).otherwise(0)).alias("fn"),
    )
    whole = m.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(whole)).select("label", "tp", "fp", "fn", (F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), (F.col("tp") + F.col("fn")).alias("support"))


def class_scores(df: DataFrame, y: str, p: str, beta: float = 1.0) -> DataFrame:
    """precision, recall, fbeta, jaccard and support of every label."""
    b = beta * beta
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(df, y, p).select(
        "label",
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero((1 + b) * tp, (1 + b) * tp + b * fn + fp).alias("fbeta"),
        _or_zero(tp, tp + fp + fn).alias("jaccard"),
        "support",
    )


def averaged_score(df: DataFrame, y: str, p: str, score: str, average: str = "macro", beta: float = 1.0) -> DataFrame:
    """One of class_scores over all labels: macro (mean), weighted (by support) or micro (of the summed counts)."""
    if average == "micro":
        b = beta * beta
        sums = class_counts(df, y, p).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        value = {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "fbeta": ((1 + b) * tp, (1 + b) * tp + b * fn + fp), "jaccard": (tp, tp + fp + fn)}[score]
        return sums.select(_or_zero(*value).alias(score))
    rows = class_scores(df, y, p, beta)
    value = F.avg(score) if average == "macro" else _or_zero(F.sum(F.col(score) * F.col("support")), F.sum("support"))
    return rows.agg(value.alias(score))


def accuracy_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def zero_one_loss(df: DataFrame, y: str, p: str, normalize: bool = True) -> DataFrame:
    wrong = (F.col(y) != F.col(p)).cast("double")
    return df.agg((F.avg(wrong) if normalize else F.sum(wrong)).alias("zero_one_loss"))


def balanced_accuracy_score(df: DataFrame, y: str, p: str, adjusted: bool = False) -> DataFrame:
    """Mean recall of the labels that occur; adjusted so that chance is 0."""
    rows = class_counts(df, y, p).where("support > 0").agg(F.avg(F.col("tp") / F.col("support")).alias("s"), F.count("*").alias("k"))
    s = F.col("s")
    return rows.select((F.coalesce(F.try_divide(s - 1 / F.col("k"), 1 - 1 / F.col("k")), F.lit(0.0)) if adjusted else s).alias("balanced_accuracy"))


def _agreement(df: DataFrame, y: str, p: str) -> DataFrame:
    """n, hits, sum of products of marginals, and sums of their squares."""
    c = class_counts(df, y, p)
    t, q = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    d = lambda x: x.cast("double")
    return c.agg(F.sum("support").cast("double").alias("n"), d(F.sum("tp")).alias("c"), F.sum(d(t) * d(q)).alias("tq"), F.sum(d(t) * d(t)).alias("tt"), F.sum(d(q) * d(q)).alias("qq"))


def matthews_corrcoef(df: DataFrame, y: str, p: str) -> DataFrame:
    n, c = F.col("n"), F.col("c")
    value = _or_zero(c * n - F.col("tq"), F.sqrt(n * n - F.col("qq")) * F.sqrt(n * n - F.col("tt")))
    return _agreement(df, y, p).select(value.alias("mcc"))


def cohen_kappa_score(df: DataFrame, y: str, p: str) -> DataFrame:
    n, c = F.col("n"), F.col("c")
    chance = F.col("tq") / (n * n)
    return _agreement(df, y, p).select(_or_zero(c / n - chance, 1 - chance).alias("kappa"))


def class_likelihood_ratios(df: DataFrame, y: str, p: str) -> DataFrame:
    """tpr / fpr and fnr / tnr of labels 0 and 1; null where undefined."""
    t, q = F.col(y) == 1, F.col(p) == 1
    n = lambda c: F.sum(c.cast("double"))
    row = df.agg(n(t & q).alias("tp"), n(~t & q).alias("fp"), n(t & ~q).alias("fn"), n(~t & ~q).alias("tn"))
    tpr, fpr = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))
    return row.select(F.try_divide(tpr, fpr).alias("positive"), F.try_divide(1 - tpr, 1 - fpr).alias("negative"))


def log_loss(df: DataFrame, y: str, prob: str) -> DataFrame:
    q = F.least(F.greatest(F.col(prob).cast("double"), F.lit(_EPS)), F.lit(1 - _EPS))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"))


def brier_score_loss(df: DataFrame, y: str, prob: str) -> DataFrame:
    return df.agg(F.avg((F.col(prob) - F.col(y)) ** 2).alias("brier"))


def hinge_loss(df: DataFrame, y: str, decision: str) -> DataFrame:
    """Mean of max(0, 1 - s * decision), s = 1 for label 1 and -1 else."""
    s = F.when(F.col(y) == 1, 1.0).otherwise(-1.0)
    return df.agg(F.avg(F.greatest(F.lit(0.0), 1 - s * F.col(decision))).alias("hinge"))


def threshold_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, tp, fp, fn, tn for each distinct score."""
    return _threshold_counts(df, y, score).drop("own")


def _threshold_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, tp, fp, fn, tn and own (the 1s of this very score) for each distinct score from the highest: what is at least the threshold counts as 1.

    Rows are first summed by score; the running sums go by ranges of scores.
    """
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("q"))
    whole = by.agg(F.sum("p").alias("P"), F.sum("q").alias("Q"))
    run = running(by.withColumn("own", F.col("p")), "threshold", ["p", "q"]).select("threshold", F.col("p").cast("long").alias("tp"), F.col("q").cast("long").alias("fp"), "own")
    return run.crossJoin(F.broadcast(whole)).select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("Q") - F.col("fp")).alias("tn"), "own")


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, fpr, tpr, without points inside a straight line; starts at (0, 0) with an infinite threshold."""
    c = threshold_counts(df, y, score)
    start = c.limit(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("fn") + F.col("tp")).alias("fn"), (F.col("tn") + F.col("fp")).alias("tn"))
    c = c.select("threshold", "tp", "fp", "fn", "tn").unionByName(start)
    c = neighbours(c.withColumn("below", -F.col("threshold")), ["below"], ["tp", "fp"])
    dt, df_ = F.col("tp") - F.col("before_tp"), F.col("fp") - F.col("before_fp")
    et, ef = F.col("after_tp") - F.col("tp"), F.col("after_fp") - F.col("fp")
    kept = c.withColumn("bend", F.coalesce((dt != et) | (df_ != ef), F.lit(True))).where("bend")
    return kept.select("threshold", F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    c = threshold_counts(df, y, score)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


def det_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    c = threshold_counts(df, y, score)
    return c.select("threshold", (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"), (F.col("fn") / (F.col("tp") + F.col("fn"))).alias("fnr"))


def roc_auc_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve: pairs in order, ties a half, from counts by score."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("double")).alias("p"), F.sum((F.col(y) != 1).cast("double")).alias("q"))
    run = running(by.withColumn("above", F.col("q")), "s", ["above"])  # with the score's own
    whole = by.agg(F.sum("q").alias("all_q"))
    rows = run.crossJoin(F.broadcast(whole)).select((F.col("p") * (F.col("all_q") - F.col("above") + F.col("q") / 2)).alias("good"), "p", "q")
    return rows.agg(F.try_divide(F.sum("good"), F.sum("p") * F.sum("q")).alias("roc_auc"))


def average_precision_score(df: DataFrame, y: str, score: str) -> DataFrame:
    c = _threshold_counts(df, y, score)
    rows = c.select((F.col("own") / (F.col("tp") + F.col("fn")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("part"))
    return rows.agg(F.sum("part").alias("average_precision"))


def auc(df: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoids under y over rising x."""
    rows = neighbours(df.select(F.col(x).alias("x"), F.col(y).alias("y")), ["x", "y"], ["x", "y"])
    part = (F.col("x") - F.col("before_x")) * (F.col("y") + F.col("before_y")) / 2
    return rows.select(part.alias("part")).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("auc"))


def calibration_curve(df: DataFrame, y: str, prob: str, n_bins: int = 5) -> DataFrame:
    """bin, mean predicted probability and share of label 1 of each bin of equal width that has rows."""
    b = F.least(F.floor(F.col(prob) * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.avg(prob).alias("prob_pred"), F.avg((F.col(y) == 1).cast("double")).alias("prob_true"))


# --- clusterings: from the contingency table ---


def contingency_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _clustering(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, sums of squares of cells and of both margins, entropies and mutual information."""
    m = contingency_matrix(df, a, b)
    na, nb = m.groupBy("a").agg(F.sum("n").alias("na")), m.groupBy("b").agg(F.sum("n").alias("nb"))
    whole = m.agg(F.sum("n").cast("double").alias("n_all"))
    cells = m.join(na, "a").join(nb, "b").crossJoin(F.broadcast(whole))
    d = lambda c: F.col(c).cast("double")
    main = cells.agg(F.first("n_all").alias("n"), F.sum(d("n") ** 2).alias("cc"), F.sum(d("n") / d("n_all") * F.ln(d("n") * d("n_all") / (d("na") * d("nb")))).alias("mi"))
    side = lambda t, c, name: t.crossJoin(F.broadcast(whole)).agg(F.sum(d(c) ** 2).alias(f"{name}{name}"), (-F.sum(d(c) / d("n_all") * F.ln(d(c) / d("n_all")))).alias(f"h{name}"))
    return main.crossJoin(side(na, "na", "a")).crossJoin(side(nb, "nb", "b"))


def clustering_expressions(beta: float = 1.0) -> dict[str, Column]:
    n, cc, aa, bb, mi, ha, hb = (F.col(c) for c in ("n", "cc", "aa", "bb", "mi", "ha", "hb"))
    pairs = n * (n - 1) / 2
    both, one, two = (cc - n) / 2, (aa - n) / 2, (bb - n) / 2
    expected = F.try_divide(one * two, pairs)
    top = (one + two) / 2 - expected
    homogeneity = F.when(ha == 0, 1.0).otherwise(F.try_divide(mi, ha))
    completeness = F.when(hb == 0, 1.0).otherwise(F.try_divide(mi, hb))
    v = _or_zero((1 + beta) * homogeneity * completeness, beta * homogeneity + completeness)
    return {
        "rand_score": F.when(n < 2, 1.0).otherwise(F.try_divide(pairs + 2 * both - one - two, pairs)),
        "adjusted_rand_score": F.when(n < 2, 1.0).when(top == 0, F.when(both - expected == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(both - expected, top)),
        "mutual_info_score": mi,
        "normalized_mutual_info_score": F.when((ha == 0) & (hb == 0), 1.0).otherwise(_or_zero(mi, (ha + hb) / 2)),
        "homogeneity_score": homogeneity,
        "completeness_score": completeness,
        "v_measure_score": v,
        "fowlkes_mallows_score": _or_zero(both, F.sqrt(one) * F.sqrt(two)),
    }


def clustering_metric(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """A measure of agreement of two labelings, by name."""
    return _clustering(df, a, b).select(clustering_expressions()[name].alias(name))


def pair_confusion_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    """Ordered pairs by whether each labeling puts them together."""
    n, cc, aa, bb = (F.col(c) for c in ("n", "cc", "aa", "bb"))
    return _clustering(df, a, b).select((n * n - aa - bb + cc).alias("apart_apart"), (bb - cc).alias("apart_together"), (aa - cc).alias("together_apart"), (cc - n).alias("together_together"))


# --- rankings: rows of (query, label, gain or relevance, score) ---


#: Rows of rankings that one task sorts, about.
RANKED = 1_000_000


def _dealt(df: DataFrame, query: str) -> DataFrame:
    """The rows by query, in as many partitions as they need for a task to sort about RANKED rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANKED)), query)


def dcg_score(df: DataFrame, query: str, gain: str, score: str, k: int | None = None, normalise: bool = False) -> DataFrame:
    """Mean over queries of the discounted gains; items of equal score share the mean of their gains. normalise: over the ideal."""

    def discount(order: str):
        at = F.row_number().over(W.partitionBy("q").orderBy(F.desc(order)))
        return F.when(at <= k, 1 / F.log2(at + 1)).otherwise(0.0) if k else 1 / F.log2(at + 1)

    rows = _dealt(df.select(F.col(query).alias("q"), F.col(gain).cast("double").alias("g"), F.col(score).alias("s")), "q").withColumn("d", discount("s"))
    rows = rows.withColumn("best", F.col("g") * discount("g")) if normalise else rows
    sums = [F.sum("best").alias("best")] if normalise else []
    tied = rows.groupBy("q", "s").agg((F.avg("g") * F.sum("d")).alias("part"), *sums)
    out = tied.groupBy("q").agg(F.sum("part").alias("dcg"), *sums)
    if not normalise:
        return out.agg(F.avg("dcg").alias("dcg"))
    return out.where("q is not null").agg(F.avg(_or_zero(F.col("dcg"), F.col("best"))).alias("ndcg"))


def coverage_error(df: DataFrame, query: str, relevant: str, score: str) -> DataFrame:
    """Mean over queries of how far down the ranking all relevant items stand; 0 without any."""
    least = df.groupBy(query).agg(F.min(F.when(F.col(relevant) == 1, F.col(score))).alias("least"))
    far = df.join(least, query).groupBy(query).agg(F.coalesce(F.sum((F.col(score) >= F.col("least")).cast("double")), F.lit(0.0)).alias("far"))
    return far.agg(F.avg("far").alias("coverage_error"))


def label_ranking_average_precision_score(df: DataFrame, query: str, relevant: str, score: str) -> DataFrame:
    df = _dealt(df.select(query, relevant, score), query)
    rank = F.count("*").over(W.partitionBy(query).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, 0))
    good = F.sum(F.col(relevant)).over(W.partitionBy(query).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, 0))
    rows = df.select(query, F.col(relevant).alias("y"), (good / rank).alias("part"))
    each = rows.groupBy(query).agg(F.avg(F.when(F.col("y") == 1, F.col("part"))).alias("p"), F.min("y").alias("a"), F.max("y").alias("b"))
    return each.agg(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("p"))).alias("lrap"))


def label_ranking_loss(df: DataFrame, query: str, relevant: str, score: str) -> DataFrame:
    """Share of (relevant, other) pairs that are not in order, mean over queries; 0 where there are no such pairs."""
    df = _dealt(df.select(query, relevant, score), query)
    other = F.sum(1 - F.col(relevant)).over(W.partitionBy(query).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, 0))
    rows = df.select(query, F.col(relevant).alias("y"), other.alias("wrong"))
    each = rows.groupBy(query).agg(F.sum(F.when(F.col("y") == 1, F.col("wrong")).otherwise(0)).alias("w"), F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("others"))
    return each.agg(F.avg(_or_zero(F.col("w"), F.col("ones") * F.col("others"))).alias("ranking_loss"))


def top_k_accuracy_score(df: DataFrame, query: str, is_true: str, score: str, k: int = 2) -> DataFrame:
    """Share of queries whose true item is among the k best scores (the item with more of them above it loses)."""
    df = _dealt(df.select(query, is_true, score), query)
    above = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), F.desc(is_true)))
    rows = df.select(query, F.col(is_true).alias("y"), above.alias("r")).where("y = 1")
    return rows.agg(F.avg((F.col("r") <= k).cast("double")).alias("top_k_accuracy"))


# --- clusterings of points: from sums of each cluster ---


def _cluster_sums(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """label, n and mean of every cluster; noise (label -1) is left out."""
    rows = df.where(F.col(label).cast("string") != "-1")
    return rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])


def calinski_harabasz_score(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Spread between clusters over spread within, each over its degrees of freedom; 1 without spread within."""
    k = F.countDistinct(label).cast("double").alias("k")
    whole = df.agg(F.count("*").cast("double").alias("n"), k, *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)])
    own = df.groupBy(label).agg(F.count("*").alias("c"), *[F.var_pop(c).alias(f"w{i}") for i, c in enumerate(columns)])
    within = own.agg(F.sum(sum((F.col("c") * F.col(f"w{i}") for i in range(len(columns))), F.lit(0.0))).alias("within"))
    total = sum((F.col("n") * F.col(f"v{i}") for i in range(len(columns))), F.lit(0.0))
    score = F.try_divide((total - F.col("within")) * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return whole.crossJoin(F.broadcast(within)).select(F.coalesce(score, F.lit(1.0)).alias("calinski_harabasz"))


def davies_bouldin_score(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance of centres; the clusters are joined with each other."""
    means = _cluster_sums(df, columns, label)
    apart = lambda a, b: F.sqrt(sum(((a(i) - b(i)) ** 2 for i in range(len(columns))), F.lit(0.0)))
    away = apart(lambda i: F.col(columns[i]), lambda i: F.col(f"m{i}"))
    spread = df.join(means.withColumnRenamed(label, "__l"), F.col(label) == F.col("__l")).groupBy("__l").agg(F.avg(away).alias("s"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(columns))])
    a = spread.select(F.col("__l").alias("la"), F.col("s").alias("sa"), *[F.col(f"m{i}").alias(f"a{i}") for i in range(len(columns))])
    b = spread.select(F.col("__l").alias("lb"), F.col("s").alias("sb"), *[F.col(f"m{i}").alias(f"b{i}") for i in range(len(columns))])
    ratio = F.coalesce(F.try_divide(F.col("sa") + F.col("sb"), apart(lambda i: F.col(f"a{i}"), lambda i: F.col(f"b{i}"))), F.lit(0.0))
    worst = a.join(b, F.col("la") != F.col("lb")).groupBy("la").agg(F.max(ratio).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))
