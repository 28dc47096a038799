"""Scores from contingency tables, reports and what curves' displays draw."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators import metrics
from tessera.operators.pairwise import DISTANCES, kernels, pairwise
from tessera.operators.ranks import running

#: Clusters on either side of a contingency table that reaches the driver.
MOST_CLUSTERS = 3000


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, precision, recall, f1, support for each label as text, then for the macro and the weighted average."""
    both = df.select(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p"))
    each = both.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q"), F.lit(0).alias("r")), F.struct(F.col("p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"), (F.col("y") == F.col("p")).cast("int").alias("r")))).alias("x"))
    counts = each.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.q").alias("told"), F.sum("x.r").alias("right"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = counts.select("label", zero(F.try_divide("right", "told")).alias("precision"), zero(F.try_divide("right", "support")).alias("recall"), zero(F.try_divide(2 * F.col("right"), F.col("told") + F.col("support"))).alias("f1"), "support")
    names = ["precision", "recall", "f1"]
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(F.when(n > 0, n / total * F.ln(n / total)).otherwise(0.0))


def homogeneity_completeness_v_measure(df: DataFrame, a: str, b: str, beta: float = 1.0) -> DataFrame:
    """homogeneity, completeness and v_measure of clusters b against classes a."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = F.lit(float(df.count()))
    ha = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(_entropy(F.col("n"), total)).first()[0] or 0.0
    hb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(_entropy(F.col("n"), total)).first()[0] or 0.0
    hab = cells.agg(_entropy(F.col("n"), total)).first()[0] or 0.0
    mutual = ha + hb - hab
    h, c = (mutual / ha if ha else 1.0), (mutual / hb if hb else 1.0)
    v = (1 + beta) * h * c / (beta * h + c) if beta * h + c else 0.0
    return df.sparkSession.createDataFrame([(h, c, v)], "homogeneity double, completeness double, v_measure double")


def adjusted_mutual_info(df: DataFrame, a: str, b: str, average: str = "arithmetic") -> float:
    """Mutual information less what chance gives, scaled to 1 at most. The cluster sizes reach the driver, MOST_CLUSTERS a side at most."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = []
    for side in ("a", "b"):
        rows = cells.groupBy(side).agg(F.sum("n")).limit(MOST_CLUSTERS + 1).collect()
        if len(rows) > MOST_CLUSTERS:
            raise InvalidParameter(f"more than {MOST_CLUSTERS} clusters")
        sides.append(np.array([r[1] for r in rows], float))
    x, y = sides
    n = x.sum()
    entropy = lambda c: float(-(c / n * np.log(c / n)).sum())
    hx, hy = entropy(x), entropy(y)
    joint = cells.agg(_entropy(F.col("n").cast("double"), F.lit(float(n)))).first()[0]
    mutual = hx + hy - joint
    expected, log = 0.0, math.lgamma
    for u, cu in zip(*np.unique(x, return_counts=True), strict=True):
        for v, cv in zip(*np.unique(y, return_counts=True), strict=True):
            k = np.arange(max(1, int(u + v - n)), int(min(u, v)) + 1, dtype=float)
            if len(k):
                chance = np.array([log(u + 1) + log(v + 1) + log(n - u + 1) + log(n - v + 1) - log(n + 1) - log(i + 1) - log(u - i + 1) - log(v - i + 1) - log(n - u - v + i + 1) for i in k])
                expected += cu * cv * float((k / n * np.log(n * k / (u * v)) * np.exp(chance)).sum())
    top = {"arithmetic": (hx + hy) / 2, "geometric": math.sqrt(hx * hy), "min": min(hx, hy), "max": max(hx, hy)}[average]
    if len(x) == len(y) == 1:
        return 1.0
    below = top - expected
    return (mutual - expected) / (below if abs(below) > 1e-15 else math.copysign(1e-15, below))


def d2_log_loss_score(df: DataFrame, y: str, prob: str) -> DataFrame:
    """1 - log loss over that of the share of label 1; y is 0 or 1."""
    share = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(prob)))
    loss = lambda q: -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.agg((1 - loss(p) / loss(F.lit(share))).alias("d2_log_loss"))


def d2_brier_score(df: DataFrame, y: str, prob: str) -> DataFrame:
    return df.agg((1 - F.avg((F.col(y) - F.col(prob)) ** 2) / F.var_pop(F.col(y).cast("double"))).alias("d2_brier"))


def d2_tweedie_score(df: DataFrame, y: str, p: str, power: float = 1.5) -> DataFrame:
    """1 - mean Tweedie deviance over that of the mean."""
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    both = df.withColumn("__mean", F.lit(mean))
    own = metrics.regression_expressions(F.col(y).cast("double"), F.col(p).cast("double"), power=power)["mean_tweedie_deviance"]
    base = metrics.regression_expressions(F.col(y).cast("double"), F.col("__mean"), power=power)["mean_tweedie_deviance"]
    return both.agg((1 - own / base).alias("d2_tweedie"))


def metric_at_thresholds(df: DataFrame, y: str, score: str, measure: Callable[[Column, Column, Column, Column], Column], weight: str | None = None) -> DataFrame:
    """threshold and measure(tn, fp, fn, tp) for each distinct score, label 1 from that score on. Weighted counts if asked for."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("n"))
    run = running(sums, "threshold", ["p", "n"])
    total = df.agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("all_p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("all_n"))
    rows = run.crossJoin(F.broadcast(total))
    return rows.select("threshold", measure(F.col("all_n") - F.col("n"), F.col("n"), F.col("all_p") - F.col("p"), F.col("p")).alias("value"))


def consensus_score(a: list[tuple[set, set]], b: list[tuple[set, set]]) -> float:
    """The best matching of two lists of biclusters (rows, columns) by Jaccard index, over the longer list."""
    n = max(len(a), len(b))
    if not n:
        return 0.0
    worth = np.zeros((n, n))
    for i, (r, c) in enumerate(a):
        for j, (s, d) in enumerate(b):
            both = len(r & s) * len(c & d)
            worth[i, j] = both / max(len(r) * len(c) + len(s) * len(d) - both, 1)
    # augmenting paths on potentials (assignment of least cost)
    cost = -worth
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[at] = True
            row, delta, to = match[at], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[row - 1, j - 1] - u[row] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < delta:
                        delta, to = least[j], j
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = to
            if not match[at]:
                break
        while at:
            match[at], at = match[way[at]], way[at]
    return float(sum(worth[match[j] - 1, j - 1] for j in range(1, n + 1)) / n)


def distance_metrics() -> list[str]:
    return sorted(DISTANCES)


def kernel_metrics() -> list[str]:
    return sorted(kernels())


def paired_distances(df: DataFrame, a: str, b: str, measure: str = "euclidean") -> DataFrame:
    from tessera.operators.pairwise import paired

    return paired(df, a, b, measure)


def pairwise_kernels(left: DataFrame, right: DataFrame, key: str, vector: str, kernel: str = "linear", **options) -> DataFrame:
    return pairwise(left, right, key, vector, kernel, kernel=True, **options)


def pairwise_distances_chunked_reduce(left: DataFrame, right: DataFrame, key: str, vector: str, reduce: Callable[[Column], Column], measure: str = "euclidean", **options) -> DataFrame:
    """a and an aggregate of its distances to all rows of right, which are never kept."""
    return pairwise(left, right, key, vector, measure, **options).groupBy("a").agg(reduce(F.col(measure)).alias("value"))


# --- what displays draw ---


def roc_curve_display(df: DataFrame, y: str, score: str) -> dict:
    return {"curve": metrics.roc_curve(df, y, score), "area": metrics.roc_auc_score(df, y, score).first()[0]}


def precision_recall_display(df: DataFrame, y: str, score: str) -> dict:
    return {"curve": metrics.precision_recall_curve(df, y, score), "average_precision": metrics.average_precision_score(df, y, score).first()[0]}


def det_curve_display(df: DataFrame, y: str, score: str) -> dict:
    return {"curve": metrics.det_curve(df, y, score)}


def confusion_matrix_display(df: DataFrame, y: str, p: str, normalise: bool = False) -> DataFrame:
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    if not normalise:
        return counts
    totals = counts.groupBy("y").agg(F.sum("n").alias("t"))
    return counts.join(totals, "y").select("y", "p", (F.col("n") / F.col("t")).alias("n"))


def prediction_error_display(df: DataFrame, y: str, p: str) -> DataFrame:
    """Each row's prediction and residual."""
    return df.select(F.col(p).alias("prediction"), (F.col(y) - F.col(p)).alias("residual"))
