"""Linear models from sufficient statistics.

One aggregate job gathers the Gram matrix of the features, of 1 and of the target (its size depends on the number of
columns alone); the driver solves it, and prediction is an expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Model, need, value
from tessera.operators.ranks import exact_quantiles


def gram(df: DataFrame, columns: Sequence[str], weight: Column | None = None, about: Sequence[float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, means, centred cross products) of the columns over rows without a missing value.

    The products are taken about a first estimate of the means, or what is given for it, which keeps digits where means are large.
    """
    need(df, columns)
    rows = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)], (weight if weight is not None else F.lit(1.0)).alias("w")).dropna()
    d = len(columns)
    rough = rows.agg(*[F.avg(f"c{i}") for i in range(d)]).first() if about is None else about
    at = [r or 0.0 for r in rough]
    x = [F.col(f"c{i}") - F.lit(at[i]) for i in range(d)]
    w = F.col("w")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = rows.agg(F.sum(w).alias("n"), *[F.sum(w * x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(w * x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = row["n"] or 0.0
    s = np.array([row[f"s{i}"] or 0.0 for i in range(d)])
    p = np.zeros((d, d))
    for i, j in pairs:
        p[i, j] = p[j, i] = row[f"p{i}_{j}"] or 0.0
    return n, np.array(at) + s / max(n, 1e-300), p - np.outer(s, s) / max(n, 1e-300)


class LinearModel(Model):
    """Prediction of a linear form."""

    def __init__(self, columns: Sequence[str], coefficients: np.ndarray, intercept: float, output: str):
        self.columns, self.coefficients, self.intercept, self.output = list(columns), np.asarray(coefficients, float), float(intercept), output

    def expression(self) -> Column:
        out: Column = F.lit(self.intercept)
        for c, b in zip(self.columns, self.coefficients.tolist(), strict=True):
            out = out + value(c) * F.lit(b)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        need(df, self.columns)
        return df.withColumn(self.output, self.expression())


class _Gram(Estimator):
    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", fit_intercept: bool = True):
        self.columns, self.target, self.output, self.fit_intercept = list(columns), target, output, fit_intercept

    def solve(self, n: float, xx: np.ndarray, xy: np.ndarray, yy: float) -> np.ndarray:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> LinearModel:
        n, mean, products = gram(df, [*self.columns, self.target])
        if not self.fit_intercept:
            products, mean = products + n * np.outer(mean, mean), np.zeros_like(mean)
        b = self.solve(n, products[:-1, :-1], products[:-1, -1], products[-1, -1])
        return LinearModel(self.columns, b, mean[-1] - mean[:-1] @ b, self.output)


class LinearRegression(_Gram):
    """Ordinary least squares; the least-norm solution where columns depend on each other."""

    def solve(self, n, xx, xy, yy):
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        return np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale


class Ridge(_Gram):
    """Least squares with alpha times the squared coefficients."""

    def __init__(self, *args, alpha: float = 1.0, **kwargs):
        super().__init__(*args, **kwargs)
        self.alpha = alpha

    def solve(self, n, xx, xy, yy):
        return np.linalg.solve(xx + self.alpha * np.eye(len(xy)), xy)


class ElasticNet(_Gram):
    """Mean squared error / 2 + alpha * (l1_ratio * l1 + (1 - l1_ratio) / 2 * l2), by coordinate descent on the Gram matrix."""

    def __init__(self, *args, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 1000, tol: float = 1e-10, **kwargs):
        super().__init__(*args, **kwargs)
        if alpha < 0 or not 0 <= l1_ratio <= 1:
            raise InvalidParameter("alpha from 0, l1_ratio from 0 to 1")
        self.alpha, self.l1_ratio, self.max_iter, self.tol = alpha, l1_ratio, max_iter, tol

    def solve(self, n, xx, xy, yy):
        g, c = xx / n, xy / n
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        b = np.zeros(len(c))
        for _ in range(self.max_iter):
            before = b.copy()
            for j in range(len(b)):
                r = c[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - l1, 0) / (g[j, j] + l2) if g[j, j] + l2 > 0 else 0.0
            if np.max(np.abs(b - before)) <= self.tol * max(1e-300, np.max(np.abs(b))):
                break
        return b


class Lasso(ElasticNet):
    """ElasticNet with the absolute penalty alone."""

    def __init__(self, *args, alpha: float = 1.0, **kwargs):
        super().__init__(*args, alpha=alpha, l1_ratio=1.0, **kwargs)


class OrthogonalMatchingPursuit(_Gram):
    """The n_nonzero columns that, one by one, are most correlated with what is left."""

    def __init__(self, *args, n_nonzero: int = 1, **kwargs):
        super().__init__(*args, **kwargs)
        self.n_nonzero = n_nonzero

    def solve(self, n, xx, xy, yy):
        chosen: list[int] = []
        b = np.zeros(len(xy))
        size = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        for _ in range(min(self.n_nonzero, len(xy))):
            rest = np.abs(xy - xx @ b) / size
            rest[chosen] = -1
            chosen.append(int(rest.argmax()))
            b[:] = 0
            b[chosen] = np.linalg.solve(xx[np.ix_(chosen, chosen)], xy[chosen])
        return b


class BayesianRidge(_Gram):
    """Ridge whose noise and weight precisions follow from the evidence."""

    def __init__(self, *args, max_iter: int = 300, tol: float = 1e-3, prior: float = 1e-6, **kwargs):
        super().__init__(*args, **kwargs)
        self.max_iter, self.tol, self.prior = max_iter, tol, prior

    def solve(self, n, xx, xy, yy):
        values, vectors = np.linalg.eigh(xx)
        turned = vectors.T @ xy
        alpha, lam = 1 / (yy / n + 2.0**-52), 1.0
        b = np.zeros(len(xy))
        for _ in range(self.max_iter):
            before = b
            b = vectors @ (turned / (values + lam / alpha))
            rss = yy - 2 * b @ xy + b @ xx @ b
            gamma = float(np.sum(alpha * values / (lam + alpha * values)))
            lam = (gamma + 2 * self.prior) / (b @ b + 2 * self.prior)
            alpha = (n - gamma + 2 * self.prior) / (rss + 2 * self.prior)
            if np.abs(b - before).sum() < self.tol:
                break
        return vectors @ (turned / (values + lam / alpha))


class HuberRegressor(Estimator):
    """Squared loss up to epsilon scales, absolute beyond: reweighted least squares.

    A step takes a pass for the sums and one for the median of the errors, which is looked for where the last ones were.
    """

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", epsilon: float = 1.35, max_iter: int = 20, tol: float = 1e-6):
        self.columns, self.target, self.output, self.epsilon, self.max_iter, self.tol = list(columns), target, output, epsilon, max_iter, tol

    def fit(self, df: DataFrame) -> LinearModel:
        model = LinearRegression(self.columns, self.target, self.output).fit(df)
        middle, near, means = None, None, None
        for _ in range(self.max_iter):
            off = F.abs(value(self.target) - model.expression())
            last, [[middle]] = middle, exact_quantiles(df, [off], [0.5], near)
            scale = (middle or 0.0) / 0.6745
            if scale <= 0:
                break
            moved = 0.001 * middle if last is None else 2 * abs(middle - last) + 1e-9 * middle
            near = (middle - moved, middle + moved)
            w = F.when(off <= self.epsilon * scale, 1.0).otherwise(self.epsilon * scale / off)
            n, mean, p = gram(df, [*self.columns, self.target], w, means)
            means = mean.tolist()
            b = np.linalg.lstsq(p[:-1, :-1], p[:-1, -1], rcond=1e-12)[0]
            done = np.max(np.abs(b - model.coefficients)) <= self.tol * max(1.0, np.max(np.abs(b)))
            model = LinearModel(self.columns, b, mean[-1] - mean[:-1] @ b, self.output)
            if done:
                break
        return model


class LogisticRegression(Estimator):
    """Two classes (0 and 1), penalty 1 / (2 C) on the coefficients: Newton steps, each one aggregate job."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "probability", C: float = 1.0, max_iter: int = 25, tol: float = 1e-8):  # noqa: N803
        self.columns, self.target, self.output, self.C, self.max_iter, self.tol = list(columns), target, output, C, max_iter, tol

    def fit(self, df: DataFrame) -> LogisticModel:
        x = [F.lit(1.0), *[value(c) for c in self.columns]]
        d = len(x)
        b = np.zeros(d)
        y = value(self.target)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        for _ in range(self.max_iter):
            z = sum((F.lit(float(b[i])) * x[i] for i in range(1, d)), F.lit(float(b[0])))
            p = 1 / (1 + F.exp(-z))
            rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], (y - p).alias("e"), (p * (1 - p)).alias("w"))
            row = rows.agg(*[F.sum(F.col("e") * F.col(f"x{i}")) for i in range(d)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
            g, h = np.array(row[:d], float), np.zeros((d, d))
            for k, (i, j) in enumerate(pairs):
                h[i, j] = h[j, i] = row[d + k]
            shrink = np.array([0.0] + [1 / self.C] * (d - 1))
            step = np.linalg.solve(h + np.diag(shrink) + 1e-12 * np.eye(d), g - shrink * b)
            b = b + step
            if np.max(np.abs(step)) < self.tol:
                break
        return LogisticModel(self.columns, b[1:], b[0], self.output)


class LogisticModel(LinearModel):
    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, 1 / (1 + F.exp(-self.expression())))
