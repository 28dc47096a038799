"""Feature scores and selectors: one aggregate job over all columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.functions.special import beta_regularised, gamma_upper
from tessera.operators.base import Estimator, need, value
from tessera.operators.preprocess import Dropped


def f_classif(df: DataFrame, columns: Sequence[str], y: str) -> dict[str, tuple[float, float]]:
    """ANOVA F and p of each column between the classes of y."""
    need(df, [*columns, y])
    rows = df.groupBy(y).agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.sum(value(c)).alias(f"s{i}"), F.sum(value(c) ** 2).alias(f"q{i}"))]).collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    out = {}
    for i, c in enumerate(columns):
        total = sum(r[f"s{i}"] for r in rows)
        between = sum(r[f"s{i}"] ** 2 / r["n"] for r in rows) - total**2 / n
        within = sum(r[f"q{i}"] for r in rows) - sum(r[f"s{i}"] ** 2 / r["n"] for r in rows)
        a, b = between / (k - 1) if k > 1 else math.nan, within / (n - k) if n > k else 0.0
        f = math.nan if a == 0 and b == 0 else math.inf if b == 0 else a / b
        p = 0.0 if f == math.inf else math.nan if math.isnan(f) else beta_regularised((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f))
        out[c] = (f, p)
    return out


def chi2(df: DataFrame, columns: Sequence[str], y: str) -> dict[str, tuple[float, float]]:
    """Chi-squared of class sums of non-negative columns against what class shares let expect, and p."""
    rows = df.groupBy(y).agg(F.count("*").alias("n"), *[F.sum(value(c)).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
    n = sum(r["n"] for r in rows)
    out = {}
    for i, c in enumerate(columns):
        total = sum(r[f"s{i}"] for r in rows)
        if total < 0:
            raise InvalidParameter(f"{c} has negative values")
        score = sum((r[f"s{i}"] - total * r["n"] / n) ** 2 / (total * r["n"] / n) for r in rows) if total else math.nan
        out[c] = (score, gamma_upper((len(rows) - 1) / 2, score / 2) if score == score else math.nan)
    return out


def r_regression(df: DataFrame, columns: Sequence[str], y: str) -> dict[str, float]:
    """Pearson correlation of each column with y."""
    row = df.agg(*[F.corr(value(c), value(y)).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"r{i}"] for i, c in enumerate(columns)}


def f_regression(df: DataFrame, columns: Sequence[str], y: str) -> dict[str, tuple[float, float]]:
    """r**2 / (1 - r**2) * (n - 2) and p of each column."""
    n = df.count()
    out = {}
    for c, r in r_regression(df, columns, y).items():
        f = math.inf if r * r >= 1 else r * r / (1 - r * r) * (n - 2)
        out[c] = (f, 0.0 if f == math.inf else beta_regularised((n - 2) / 2, 0.5, (n - 2) / (n - 2 + f)))
    return out


SCORES = {"f_classif": f_classif, "chi2": chi2, "f_regression": f_regression}


class Selector(Estimator):
    """Keeps columns by score: k_best, percentile, fpr (p < alpha), fwe (p < alpha / m) or fdr (Benjamini-Hochberg)."""

    def __init__(self, columns: Sequence[str], y: str, mode: str = "k_best", param: float = 10, score: str = "f_classif"):
        if mode not in ("k_best", "percentile", "fpr", "fwe", "fdr"):
            raise InvalidParameter(f"no mode {mode}")
        self.columns, self.y, self.mode, self.param, self.score = list(columns), y, mode, param, score

    def fit(self, df: DataFrame) -> Dropped:
        found = SCORES[self.score](df, self.columns, self.y)
        order = sorted(self.columns, key=lambda c: (-found[c][0], self.columns.index(c)))
        m = len(order)
        if self.mode == "k_best":
            kept = order[: int(self.param)]
        elif self.mode == "percentile":
            kept = order[: max(1, math.ceil(m * self.param / 100))] if self.param else []
        elif self.mode in ("fpr", "fwe"):
            kept = [c for c in order if found[c][1] < self.param / (m if self.mode == "fwe" else 1)]
        else:
            by_p = sorted(order, key=lambda c: found[c][1])
            last = max((i + 1 for i, c in enumerate(by_p) if found[c][1] <= self.param * (i + 1) / m), default=0)
            kept = by_p[:last]
        self.kept = [c for c in self.columns if c in kept]
        return Dropped([c for c in self.columns if c not in kept])
