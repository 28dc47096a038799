"""Linear models beyond least squares: paths and their validation, generalised linear models, discriminants, margins.

All work from sums: Gram matrices by fold or class in one job, or one aggregate job a step. What reaches the driver
depends on columns, classes, folds and candidate settings, never on rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.base import Estimator, Model, need, value
from tessera.operators.bayes import ClassScores
from tessera.operators.linear import ElasticNet, LinearModel, LinearRegression, OrthogonalMatchingPursuit, Ridge, _Gram, gram
from tessera.operators.trees import _labels

Moments = tuple[float, np.ndarray, np.ndarray]


def grams(df: DataFrame, columns: Sequence[str], by: Column) -> dict:
    """(n, means, centred cross products) of the columns for each value of `by`, in one job after one for rough means."""
    need(df, columns)
    rows = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)], by.alias("by")).dropna()
    d = len(columns)
    at = [r or 0.0 for r in rows.agg(*[F.avg(f"c{i}") for i in range(d)]).first()]
    x = [F.col(f"c{i}") - F.lit(at[i]) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = {}
    for row in rows.groupBy("by").agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect():
        n, s, p = float(row["n"]), np.array([row[f"s{i}"] for i in range(d)], float), np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = row[f"p{i}_{j}"]
        out[row["by"]] = (n, np.array(at) + s / n, p - np.outer(s, s) / n)
    return out


def merged(parts: Sequence[Moments]) -> Moments:
    """The moments of all rows together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    products = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
    return n, mean, products


def fold_of(key: Sequence[str], folds: int, seed: int = 0) -> Column:
    """A row's fold by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)).cast("int")


def squared_error(part: Moments, coefficients: np.ndarray, intercept: float) -> float:
    """Sum of squared errors of a linear form over the rows of `part`, whose last column is the target."""
    n, mean, p = part
    v = np.append(-coefficients, 1.0)
    return float(v @ p @ v + n * (v @ mean - intercept) ** 2)


class _Validated(Estimator):
    """The candidate setting of least squared error over folds (a hash of `key`), refitted on all rows.

    Every fold's Gram matrix comes from one job; each candidate is then solved and scored from those alone.
    """

    def __init__(self, columns: Sequence[str], target: str, key: Sequence[str], output: str = "prediction", folds: int = 5, candidates: Sequence[dict] | None = None, seed: int = 0, **settings):
        self.columns, self.target, self.key, self.output, self.folds, self.candidates, self.seed, self.settings = list(columns), target, list(key), output, folds, candidates, seed, settings

    def grid(self, whole: Moments) -> list[dict]:
        raise NotImplementedError

    def kind(self, **setting) -> _Gram:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> LinearModel:
        parts = list(grams(df, [*self.columns, self.target], fold_of(self.key, self.folds, self.seed)).values())
        if len(parts) < 2:
            raise InsufficientSamples("fewer than two folds have rows")
        whole = merged(parts)
        grid = list(self.candidates or self.grid(whole))
        errors = np.zeros((len(grid), len(parts)))
        for k, part in enumerate(parts):
            n, mean, p = merged([q for q in parts if q is not part])
            for i, setting in enumerate(grid):
                b = self.kind(**setting).solve(n, p[:-1, :-1], p[:-1, -1], p[-1, -1])
                errors[i, k] = squared_error(part, b, mean[-1] - mean[:-1] @ b) / part[0]
        self.errors, self.best = errors, grid[int(errors.mean(axis=1).argmin())]
        n, mean, p = whole
        b = self.kind(**self.best).solve(n, p[:-1, :-1], p[:-1, -1], p[-1, -1])
        return LinearModel(self.columns, b, mean[-1] - mean[:-1] @ b, self.output)


def _alphas(whole: Moments, l1_ratio: float, n_alphas: int, eps: float) -> np.ndarray:
    n, _, p = whole
    top = float(np.abs(p[:-1, -1]).max()) / n / max(l1_ratio, 1e-3)
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * eps, n_alphas)


class ElasticNetCV(_Validated):
    """ElasticNet with alpha (of n_alphas down from where all weights are 0) and l1_ratio by cross-validation."""

    l1_ratios: Sequence[float] = (0.5,)

    def grid(self, whole):
        return [{"alpha": float(a), "l1_ratio": r} for r in self.settings.get("l1_ratios", self.l1_ratios) for a in _alphas(whole, r, self.settings.get("n_alphas", 100), self.settings.get("eps", 1e-3))]

    def kind(self, **setting):
        return ElasticNet(self.columns, self.target, **setting)


class LassoCV(ElasticNetCV):
    l1_ratios = (1.0,)


class OrthogonalMatchingPursuitCV(_Validated):
    """OrthogonalMatchingPursuit with the number of columns by cross-validation."""

    def grid(self, whole):
        return [{"n_nonzero": k} for k in range(1, len(self.columns) + 1)]

    def kind(self, **setting):
        return OrthogonalMatchingPursuit(self.columns, self.target, **setting)


def enet_path(df: DataFrame, columns: Sequence[str], target: str, alphas: Sequence[float] | None = None, l1_ratio: float = 0.5, n_alphas: int = 100, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(alphas, coefficients by column and alpha) from one Gram matrix, centred."""
    whole = gram(df, [*columns, target])
    alphas = np.sort(np.array(alphas if alphas is not None else _alphas(whole, l1_ratio, n_alphas, eps), float))[::-1]
    n, _, p = whole
    return alphas, np.stack([ElasticNet(columns, target, alpha=float(a), l1_ratio=l1_ratio).solve(n, p[:-1, :-1], p[:-1, -1], p[-1, -1]) for a in alphas], axis=1)


def lasso_path(df: DataFrame, columns: Sequence[str], target: str, **options) -> tuple[np.ndarray, np.ndarray]:
    return enet_path(df, columns, target, l1_ratio=1.0, **options)


def lars_path_gram(xx: np.ndarray, xy: np.ndarray, method: str = "lasso", max_steps: int = 500, alpha_min: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(correlations, coefficients by column and step) of least angle regression; with method lasso columns whose
    coefficient meets 0 leave again. A step goes to where another column is as correlated with what is left."""
    d = len(xy)
    b, active, steps, knots = np.zeros(d), [], [], []
    barred = -1
    for _ in range(max_steps):
        c = xy - xx @ b
        top = float(np.abs(c).max()) if d else 0.0
        knots.append(top)
        steps.append(b.copy())
        if top <= max(alpha_min, 1e-12 * max(1.0, float(np.abs(xy).max()))):
            break
        if barred < 0:
            idle = [j for j in range(d) if j not in active]
            if idle and len(active) < d:
                active.append(max(idle, key=lambda j: abs(c[j])))
        signs = np.sign(c[active])
        way = np.linalg.lstsq(xx[np.ix_(active, active)], signs, rcond=1e-12)[0]
        slope = xx[:, active] @ way
        length, enters = top, -1  # to where the correlation is 0
        for j in range(d):
            if j not in active:
                for g in ((top - c[j]) / max(1 - slope[j], 1e-300), (top + c[j]) / max(1 + slope[j], 1e-300)):
                    if 1e-14 < g < length and j != barred:
                        length, enters = g, j
        leaves = -1
        if method == "lasso":
            for i, j in enumerate(active):
                g = -b[j] / way[i] if way[i] else np.inf
                if 1e-14 < g < length:
                    length, leaves = g, j
        stop = top - length < alpha_min
        if stop:
            length = top - alpha_min
        b[active] += length * way
        barred = -1
        if leaves >= 0 and not stop:
            b[leaves] = 0.0
            active.remove(leaves)
            barred = leaves
        elif enters < 0 or stop:
            knots.append(float(np.abs(xy - xx @ b).max()))
            steps.append(b.copy())
            break
    return np.array(knots), np.stack(steps, axis=1)


def lars_path(df: DataFrame, columns: Sequence[str], target: str, method: str = "lar") -> tuple[np.ndarray, np.ndarray]:
    n, _, p = gram(df, [*columns, target])
    knots, steps = lars_path_gram(p[:-1, :-1], p[:-1, -1], method)
    return knots / n, steps


class Lars(_Gram):
    """Least angle regression until n_nonzero columns are in."""

    def __init__(self, *args, n_nonzero: int | None = None, **kwargs):
        super().__init__(*args, **kwargs)
        self.n_nonzero = n_nonzero

    def solve(self, n, xx, xy, yy):
        _, steps = lars_path_gram(xx, xy, "lar")
        most = len(xy) if self.n_nonzero is None else self.n_nonzero
        fits = [k for k in range(steps.shape[1]) if np.count_nonzero(steps[:, k]) <= most]
        return steps[:, fits[-1]]


class LassoLars(_Gram):
    """The lasso at alpha by least angle regression."""

    def __init__(self, *args, alpha: float = 1.0, **kwargs):
        super().__init__(*args, **kwargs)
        self.alpha = alpha

    def solve(self, n, xx, xy, yy):
        return lars_path_gram(xx, xy, "lasso", alpha_min=self.alpha * n)[1][:, -1]


class LassoLarsIC(_Gram):
    """The step of the lasso path of least aic or bic."""

    def __init__(self, *args, criterion: str = "aic", **kwargs):
        super().__init__(*args, **kwargs)
        if criterion not in ("aic", "bic"):
            raise InvalidParameter("criterion aic or bic")
        self.criterion = criterion

    def solve(self, n, xx, xy, yy):
        _, steps = lars_path_gram(xx, xy, "lasso")
        full = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
        noise = (yy - full @ xy) / max(n - len(xy) - 1, 1)
        price = 2.0 if self.criterion == "aic" else math.log(n)
        scores = [n * math.log(2 * math.pi * noise) + (yy - 2 * b @ xy + b @ xx @ b) / noise + price * np.count_nonzero(b) for b in steps.T]
        return steps[:, int(np.argmin(scores))]


class ARDRegression(_Gram):
    """Bayesian ridge with a precision for each weight; columns whose precision passes `threshold` have weight 0."""

    def __init__(self, *args, max_iter: int = 300, tol: float = 1e-3, prior: float = 1e-6, threshold: float = 1e4, **kwargs):
        super().__init__(*args, **kwargs)
        self.max_iter, self.tol, self.prior, self.threshold = max_iter, tol, prior, threshold

    def solve(self, n, xx, xy, yy):
        d = len(xy)
        alpha, lam, keep, b = 1 / (yy / n + 2.0**-52), np.ones(d), np.ones(d, bool), np.zeros(d)
        for _ in range(self.max_iter):
            before = b.copy()
            sigma = np.linalg.inv(np.diag(lam[keep]) + alpha * xx[np.ix_(keep, keep)])
            b = np.zeros(d)
            b[keep] = alpha * sigma @ xy[keep]
            rss = yy - 2 * b @ xy + b @ xx @ b
            gamma = 1 - lam[keep] * np.diag(sigma)
            lam[keep] = (gamma + 2 * self.prior) / (b[keep] ** 2 + 2 * self.prior)
            alpha = (n - gamma.sum() + 2 * self.prior) / (rss + 2 * self.prior)
            keep = lam < self.threshold
            b[~keep] = 0
            if np.abs(b - before).sum() < self.tol or not keep.any():
                break
        return b


def ridge_regression(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 1.0) -> np.ndarray:
    """Ridge coefficients without an intercept."""
    return Ridge(columns, target, fit_intercept=False, alpha=alpha).fit(df).coefficients


class RidgeCV(Estimator):
    """Ridge with the alpha of least leave-one-out error: errors are scaled by each row's leverage, all alphas in one job."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", alphas: Sequence[float] = (0.1, 1.0, 10.0)):
        self.columns, self.target, self.output, self.alphas = list(columns), target, output, list(alphas)

    def fit(self, df: DataFrame) -> LinearModel:
        n, mean, p = gram(df, [*self.columns, self.target])
        xx, xy = p[:-1, :-1], p[:-1, -1]
        x = [value(c) - F.lit(float(m)) for c, m in zip(self.columns, mean, strict=False)]
        d, models, sums = len(x), [], []
        for alpha in self.alphas:
            inverse = np.linalg.inv(xx + alpha * np.eye(d))
            b = inverse @ xy
            model = LinearModel(self.columns, b, mean[-1] - mean[:-1] @ b, self.output)
            lever = F.lit(1 / n)
            for i, j in itertools.product(range(d), repeat=2):
                lever = lever + F.lit(float(inverse[i, j])) * x[i] * x[j]
            models.append(model)
            sums.append(F.avg(((value(self.target) - model.expression()) / (1 - lever)) ** 2))
        self.errors = list(df.agg(*sums).first())
        k = int(np.argmin(self.errors))
        self.alpha = self.alphas[k]
        return models[k]


def _columns_of(scores: Sequence[Column], classes: Sequence, output: str) -> ClassScores:
    return ClassScores(classes, scores, output)


class RidgeClassifier(Estimator):
    """Ridge on 1 for a class and -1 for the others; the class of the greatest prediction."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", alpha: float = 1.0):
        self.columns, self.target, self.output, self.alpha = list(columns), target, output, alpha

    def solve(self, df: DataFrame, sign: str) -> LinearModel:
        return Ridge(self.columns, sign, alpha=self.alpha).fit(df)

    def fit(self, df: DataFrame) -> ClassScores:
        classes = _labels(df, self.target)
        models = []
        for label in classes[1:] if len(classes) == 2 else classes:
            signed = df.withColumn("__sign", F.when(F.col(self.target) == F.lit(label), 1.0).when(F.col(self.target).isNotNull(), -1.0))
            models.append(self.solve(signed, "__sign").expression())
        scores = [-models[0], models[0]] if len(classes) == 2 else models
        return _columns_of(scores, classes, self.output)


class RidgeClassifierCV(RidgeClassifier):
    """RidgeClassifier with the alpha of least leave-one-out error for each class."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", alphas: Sequence[float] = (0.1, 1.0, 10.0)):
        super().__init__(columns, target, output)
        self.alphas = alphas

    def solve(self, df, sign):
        return RidgeCV(self.columns, sign, alphas=self.alphas).fit(df)


class MultiTaskElasticNet(Estimator):
    """Several targets whose weights of a column are 0 together: block coordinate descent on the Gram matrix."""

    def __init__(self, columns: Sequence[str], targets: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 1000, tol: float = 1e-8):
        self.columns, self.targets, self.alpha, self.l1_ratio, self.max_iter, self.tol = list(columns), list(targets), alpha, l1_ratio, max_iter, tol

    def solve(self, moments: Moments) -> tuple[np.ndarray, np.ndarray]:
        n, mean, p = moments
        d = len(self.columns)
        g, c = p[:d, :d] / n, p[:d, d:] / n
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        b = np.zeros(c.shape)
        for _ in range(self.max_iter):
            before = b.copy()
            for j in range(d):
                r = c[j] - g[j] @ b + g[j, j] * b[j]
                size = np.linalg.norm(r)
                b[j] = r * max(1 - l1 / size, 0) / (g[j, j] + l2) if size > 0 and g[j, j] + l2 > 0 else 0.0
            if np.abs(b - before).max() <= self.tol * max(1e-300, np.abs(b).max()):
                break
        return b, mean[d:] - mean[:d] @ b

    def fit(self, df: DataFrame) -> MultiLinearModel:
        self.coefficients, intercepts = self.solve(gram(df, [*self.columns, *self.targets]))
        return MultiLinearModel([LinearModel(self.columns, w, float(i), f"{t}_prediction") for t, w, i in zip(self.targets, self.coefficients.T, intercepts, strict=True)])


class MultiTaskLasso(MultiTaskElasticNet):
    def __init__(self, columns: Sequence[str], targets: Sequence[str], alpha: float = 1.0, **options):
        super().__init__(columns, targets, alpha, 1.0, **options)


class MultiTaskElasticNetCV(Estimator):
    """MultiTaskElasticNet with alpha by cross-validation from the folds' Gram matrices."""

    l1_ratio = 0.5

    def __init__(self, columns: Sequence[str], targets: Sequence[str], key: Sequence[str], alphas: Sequence[float], folds: int = 5):
        self.columns, self.targets, self.key, self.alphas, self.folds = list(columns), list(targets), list(key), list(alphas), folds

    def fit(self, df: DataFrame) -> MultiLinearModel:
        parts = list(grams(df, [*self.columns, *self.targets], fold_of(self.key, self.folds)).values())
        d, errors = len(self.columns), []
        for alpha in self.alphas:
            error = 0.0
            for part in parts:
                b, start = MultiTaskElasticNet(self.columns, self.targets, alpha, self.l1_ratio).solve(merged([q for q in parts if q is not part]))
                for t in range(len(self.targets)):
                    keep = [*range(d), d + t]
                    error += squared_error((part[0], part[1][keep], part[2][np.ix_(keep, keep)]), b[:, t], start[t])
            errors.append(error)
        self.alpha = self.alphas[int(np.argmin(errors))]
        return MultiTaskElasticNet(self.columns, self.targets, self.alpha, self.l1_ratio).fit(df)


class MultiTaskLassoCV(MultiTaskElasticNetCV):
    l1_ratio = 1.0


class MultiLinearModel(Model):
    def __init__(self, models: Sequence[LinearModel]):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({m.output: m.expression() for m in self.models})


class GLMRegressor(Estimator):
    """Generalised linear model by Newton steps, one aggregate job each: mean exp(form) (link log) or the form itself,
    variance mean ** power; alpha / 2 times the squared weights is added to the mean deviance / 2."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", power: float = 0.0, link: str = "log", alpha: float = 1.0, max_iter: int = 50, tol: float = 1e-9):
        if link not in ("log", "identity") or alpha < 0 or 0 < power < 1:
            raise InvalidParameter("link log or identity, alpha from 0, power 0 or from 1")
        self.columns, self.target, self.output, self.power, self.link, self.alpha, self.max_iter, self.tol = list(columns), target, output, power, link, alpha, max_iter, tol

    def fit(self, df: DataFrame) -> LinearModel:
        need(df, [*self.columns, self.target])
        first = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns, 1)], value(self.target).alias("y")).dropna()
        start = first.agg(F.count("*"), F.avg("y"), F.min("y"), *[F.avg(f"x{i}") for i in range(1, len(self.columns) + 1)], *[F.stddev_pop(f"x{i}") for i in range(1, len(self.columns) + 1)]).first()
        n, mean, least = start[0], start[1], start[2]
        if not n:
            raise InsufficientSamples("no rows to fit on")
        if self.power >= 2 and least <= 0 or self.power >= 1 and least < 0:
            raise InvalidParameter("the target is outside the distribution's range")
        d = len(self.columns)
        at, scale = np.array(start[3 : 3 + d], float), np.array([s or 1.0 for s in start[3 + d :]], float)
        rows = first.select(F.lit(1.0).alias("x0"), *[((F.col(f"x{i}") - float(at[i - 1])) / float(scale[i - 1])).alias(f"x{i}") for i in range(1, d + 1)], "y")
        log = self.link == "log"
        b = np.zeros(d + 1)
        b[0] = math.log(max(mean, 1e-12)) if log else mean
        shrink = np.append(0.0, self.alpha / scale**2)
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        for _ in range(self.max_iter):
            form = sum((F.lit(float(w)) * F.col(f"x{i}") for i, w in enumerate(b) if i), F.lit(float(b[0])))
            mu = F.exp(form) if log else form
            slope = mu if log else F.lit(1.0)
            weight = slope * slope / mu**self.power if self.power else slope * slope
            pull = (F.col("y") - mu) * slope / mu**self.power if self.power else (F.col("y") - mu) * slope
            stepped = rows.select("*", weight.alias("w"), pull.alias("e"))
            row = stepped.agg(*[F.avg(F.col("e") * F.col(f"x{i}")) for i in range(d + 1)], *[F.avg(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
            g, h = np.array(row[: d + 1], float) - shrink * b, np.diag(shrink) + 1e-14 * np.eye(d + 1)
            for k, (i, j) in enumerate(pairs):
                h[i, j] += row[d + 1 + k]
                h[j, i] = h[i, j]
            step = np.clip(np.linalg.lstsq(h, g, rcond=1e-14)[0], -5, 5)
            b = b + step
            if np.abs(step).max() < self.tol * max(1.0, np.abs(b).max()):
                break
        w = b[1:] / scale
        return (ExpModel if log else LinearModel)(self.columns, w, b[0] - at @ w, self.output)


class ExpModel(LinearModel):
    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, F.exp(self.expression()))


class PoissonRegressor(GLMRegressor):
    def __init__(self, *args, **kwargs):
        super().__init__(*args, power=1.0, **kwargs)


class GammaRegressor(GLMRegressor):
    def __init__(self, *args, **kwargs):
        super().__init__(*args, power=2.0, **kwargs)


class TweedieRegressor(GLMRegressor):
    """Any power; the link is identity for power 0 and log otherwise unless it is given."""

    def __init__(self, *args, power: float = 0.0, link: str = "auto", **kwargs):
        super().__init__(*args, power=power, link=link if link != "auto" else "identity" if power == 0 else "log", **kwargs)


class QuantileRegressor(Estimator):
    """The linear form of least pinball loss at `quantile` plus alpha times the absolute weights: least squares with weights
    1 / (eps + |error|), which bound the loss from above, one job a step while eps falls."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", quantile: float = 0.5, alpha: float = 0.0, max_iter: int = 60):
        if not 0 < quantile < 1:
            raise InvalidParameter("quantile between 0 and 1")
        self.columns, self.target, self.output, self.quantile, self.alpha, self.max_iter = list(columns), target, output, quantile, alpha, max_iter

    def fit(self, df: DataFrame) -> LinearModel:
        y = value(self.target)
        model = LinearRegression(self.columns, self.target, self.output).fit(df)
        spread = df.agg(F.stddev_pop(y)).first()[0] or 1.0
        eps, last = spread * 0.1, None
        for _ in range(self.max_iter):
            off = y - model.expression()
            w = 1 / (F.abs(off) + F.lit(eps))
            shifted = df.withColumn("__y", y + F.lit(2 * self.quantile - 1) / w)
            n, mean, p = gram(shifted, [*self.columns, "__y"], w)
            shrink = 2 * self.alpha * df.count() / np.maximum(np.abs(model.coefficients), eps) if self.alpha else np.zeros(len(self.columns))
            b = np.linalg.lstsq(p[:-1, :-1] + np.diag(shrink), p[:-1, -1], rcond=1e-13)[0]
            model = LinearModel(self.columns, b, mean[-1] - mean[:-1] @ b, self.output)
            now = np.append(b, model.intercept)
            if last is not None and np.abs(now - last).max() <= 1e-7 * spread and eps <= spread * 1e-6:
                break
            last, eps = now, max(eps * 0.5, spread * 1e-7)
        return model


class LinearDiscriminantAnalysis(Estimator):
    """Classes of normal columns with one covariance (pooled, over n - classes): linear scores from one job."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", shrinkage: float = 0.0):
        self.columns, self.target, self.output, self.shrinkage = list(columns), target, output, shrinkage

    def fit(self, df: DataFrame) -> ClassScores:
        parts = grams(df.where(F.col(self.target).isNotNull()), self.columns, F.col(self.target))
        classes = sorted(parts)
        n = sum(parts[c][0] for c in classes)
        pooled = sum(parts[c][2] for c in classes) / max(n - len(classes), 1)
        d = len(self.columns)
        pooled = (1 - self.shrinkage) * pooled + self.shrinkage * np.trace(pooled) / d * np.eye(d)
        self.means, self.covariance, self.classes = np.array([parts[c][1] for c in classes]), pooled, classes
        inverse = np.linalg.pinv(pooled)
        scores = []
        for c in classes:
            k, mean, _ = parts[c]
            w = inverse @ mean
            scores.append(LinearModel(self.columns, w, -0.5 * mean @ w + math.log(k / n), "").expression())
        between = sum(parts[c][0] * np.outer(parts[c][1] - self.means.mean(axis=0), parts[c][1] - self.means.mean(axis=0)) for c in classes) / n
        values, vectors = np.linalg.eig(inverse @ between)
        order = np.argsort(-values.real)[: max(len(classes) - 1, 1)]
        self.scalings = vectors.real[:, order]
        return _columns_of(scores, classes, self.output)


class QuadraticDiscriminantAnalysis(Estimator):
    """Classes of normal columns, each with its own covariance (over n - 1) and reg_param times the identity."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", reg_param: float = 0.0):
        self.columns, self.target, self.output, self.reg_param = list(columns), target, output, reg_param

    def fit(self, df: DataFrame) -> ClassScores:
        parts = grams(df.where(F.col(self.target).isNotNull()), self.columns, F.col(self.target))
        classes = sorted(parts)
        n, d, scores = sum(parts[c][0] for c in classes), len(self.columns), []
        for c in classes:
            k, mean, p = parts[c]
            if k < 2:
                raise InsufficientSamples(f"class {c} has fewer than two rows")
            own = (1 - self.reg_param) * p / (k - 1) + self.reg_param * np.eye(d)
            inverse = np.linalg.pinv(own)
            x = [value(col) - F.lit(float(m)) for col, m in zip(self.columns, mean, strict=True)]
            far = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i, j in itertools.product(range(d), repeat=2)), F.lit(0.0))
            scores.append(F.lit(math.log(k / n) - 0.5 * np.linalg.slogdet(own)[1]) - 0.5 * far)
        return _columns_of(scores, classes, self.output)


class LinearSVC(Estimator):
    """Squared hinge loss times C plus half the squared weights (the intercept's with them), by Newton steps; labels 0 and 1 or any two."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", C: float = 1.0, max_iter: int = 50, tol: float = 1e-8):  # noqa: N803
        self.columns, self.target, self.output, self.C, self.max_iter, self.tol = list(columns), target, output, C, max_iter, tol

    def _solve(self, df: DataFrame, y: Column, regression: bool = False, epsilon: float = 0.0) -> LinearModel:
        d = len(self.columns)
        rows = df.select(F.lit(1.0).alias("x0"), *[value(c).alias(f"x{i}") for i, c in enumerate(self.columns, 1)], y.cast("double").alias("y")).dropna()
        b = np.zeros(d + 1)
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        for _ in range(self.max_iter):
            form = sum((F.lit(float(w)) * F.col(f"x{i}") for i, w in enumerate(b)), F.lit(0.0))
            if regression:
                off = F.col("y") - form
                pull = F.when(off > epsilon, off - epsilon).when(off < -epsilon, off + epsilon).otherwise(0.0)
            else:
                pull = F.when(F.col("y") * form < 1, F.col("y") - form).otherwise(0.0)  # y * (1 - y * form)
            stepped = rows.select("*", pull.alias("e")).withColumn("on", (F.col("e") != 0).cast("double"))
            row = stepped.agg(*[F.sum(F.col("e") * F.col(f"x{i}")) for i in range(d + 1)], *[F.sum(F.col("on") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
            g, h = 2 * self.C * np.array([r or 0.0 for r in row[: d + 1]]) - b, np.eye(d + 1)
            for k, (i, j) in enumerate(pairs):
                v = 2 * self.C * (row[d + 1 + k] or 0.0)
                h[i, j] += v
                if i != j:
                    h[j, i] += v
            step = np.linalg.solve(h, g)
            b = b + step
            if np.abs(step).max() <= self.tol * max(1.0, np.abs(b).max()):
                break
        return LinearModel(self.columns, b[1:], b[0], self.output)

    def fit(self, df: DataFrame) -> ClassScores:
        classes = _labels(df, self.target)
        if len(classes) < 2:
            raise InsufficientSamples("fewer than two classes")
        own = classes[1:] if len(classes) == 2 else classes
        forms = [self._solve(df, F.when(F.col(self.target) == F.lit(c), 1.0).when(F.col(self.target).isNotNull(), -1.0)).expression() for c in own]
        return _columns_of([-forms[0], forms[0]] if len(classes) == 2 else forms, classes, self.output)


class LinearSVR(LinearSVC):
    """Squared loss beyond epsilon, times C, plus half the squared weights."""

    def __init__(self, *args, epsilon: float = 0.0, **kwargs):
        super().__init__(*args, **kwargs)
        self.epsilon = epsilon

    def fit(self, df: DataFrame) -> LinearModel:
        return self._solve(df, value(self.target), True, self.epsilon)


def l1_min_c(df: DataFrame, columns: Sequence[str], target: str, loss: str = "squared_hinge") -> float:
    """The least C at which an l1-penalised classifier has a weight: from the correlations of columns with labels of 1 and -1."""
    classes = _labels(df, target)
    top = 0.0
    for c in classes[1:] if len(classes) == 2 else classes:
        sign = F.when(F.col(target) == F.lit(c), 1.0).otherwise(-1.0)
        row = df.agg(*[F.abs(F.sum(value(x) * sign)) for x in columns], F.abs(F.sum(sign))).first()
        top = max(top, max(v or 0.0 for v in row))
    if top == 0:
        raise InvalidParameter("no column is correlated with the labels")
    return (0.5 if loss == "squared_hinge" else 2.0) / top


# Gradients of losses by margin (labels 1 and -1) or error (regression).
def loss_gradient(name: str, form: np.ndarray, y: np.ndarray, epsilon: float = 0.1) -> np.ndarray:
    """Derivative of a loss by the linear form."""
    m, r = y * form, form - y
    if name == "hinge":
        return np.where(m < 1, -y, 0.0)
    if name == "perceptron":
        return np.where(m <= 0, -y, 0.0)
    if name == "squared_hinge":
        return np.where(m < 1, -2 * y * (1 - m), 0.0)
    if name == "log_loss":
        return -y / (1 + np.exp(np.clip(m, -50, 50)))
    if name == "modified_huber":
        return np.where(m >= 1, 0.0, np.where(m >= -1, -2 * y * (1 - m), -4 * y))
    if name == "squared_error":
        return r
    if name == "huber":
        return np.clip(r, -epsilon, epsilon)
    if name == "epsilon_insensitive":
        return np.where(np.abs(r) > epsilon, np.sign(r), 0.0)
    if name == "squared_epsilon_insensitive":
        return 2 * np.sign(r) * np.maximum(np.abs(r) - epsilon, 0)
    raise InvalidParameter(f"unknown loss {name}")


LOSSES = ["hinge", "perceptron", "squared_hinge", "log_loss", "modified_huber", "squared_error", "huber", "epsilon_insensitive", "squared_epsilon_insensitive"]


class SGDRegressor(Estimator):
    """Stochastic gradient steps: in an epoch each task goes through its rows in blocks from the same weights, and the
    tasks' weights are averaged by their rows. Columns are scaled to mean 0 and variance 1 on the way."""

    loss = "squared_error"
    passive = 0.0

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", loss: str | None = None, alpha: float = 1e-4, rate: float = 0.05, epochs: int = 10, epsilon: float = 0.1, block: int = 32):
        self.columns, self.target, self.output, self.alpha, self.rate, self.epochs, self.epsilon, self.block = list(columns), target, output, alpha, rate, epochs, epsilon, block
        self.loss = loss or self.loss
        if self.loss not in LOSSES:
            raise InvalidParameter(f"unknown loss {self.loss}")

    def _solve(self, df: DataFrame, y: Column) -> LinearModel:
        need(df, self.columns)
        d = len(self.columns)
        rows = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns)], y.cast("double").alias("y")).dropna()
        first = rows.agg(F.count("*"), *[F.avg(f"x{i}") for i in range(d)], *[F.stddev_pop(f"x{i}") for i in range(d)]).first()
        if not first[0]:
            raise InsufficientSamples("no rows to fit on")
        at, scale = np.array(first[1 : d + 1], float), np.array([s or 1.0 for s in first[d + 1 :]], float)
        loss, alpha, epsilon, block, passive = self.loss, self.alpha, self.epsilon, self.block, self.passive
        b = np.zeros(d + 1)
        for epoch in range(self.epochs):
            rate, start = self.rate / (1 + epoch) ** 0.5, b

            def walk(batches: Iterator[pa.RecordBatch], rate=rate, start=start) -> Iterator[pa.RecordBatch]:
                w, seen = start.copy(), 0
                for batch in batches:
                    m = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
                    x = np.concatenate([(m[:, :d] - at) / scale, np.ones((len(m), 1))], axis=1)
                    for i in range(0, len(m), block):
                        part, label = x[i : i + block], m[i : i + block, -1]
                        form = part @ w
                        if passive:  # the least change that mends a row, at most `passive`
                            regress = loss in ("epsilon_insensitive", "squared_epsilon_insensitive")
                            lost = np.maximum(np.abs(form - label) - epsilon, 0) if regress else np.maximum(1 - label * form, 0)
                            way = np.sign(label - form) if regress else label
                            w = w + (np.minimum(passive, lost / (part**2).sum(axis=1)) * way) @ part / len(part)
                        else:
                            g = loss_gradient(loss, form, label, epsilon) @ part / len(part)
                            w = w - rate * (g + alpha * np.append(w[:-1], 0.0))
                    seen += len(m)
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), *[pa.array([float(v * seen)]) for v in w]], ["n", *[f"w{i}" for i in range(d + 1)]])

            kinds = ", ".join(["n double", *[f"w{i} double" for i in range(d + 1)]])
            row = rows.mapInArrow(walk, kinds).agg(F.sum("n"), *[F.sum(f"w{i}") for i in range(d + 1)]).first()
            b = np.array(row[1:], float) / row[0]
        w = b[:-1] / scale
        return LinearModel(self.columns, w, b[-1] - at @ w, self.output)

    def fit(self, df: DataFrame) -> LinearModel:
        return self._solve(df, value(self.target))


class SGDClassifier(SGDRegressor):
    """One linear form for two classes, one against the rest for more."""

    loss = "hinge"

    def fit(self, df: DataFrame) -> ClassScores:
        classes = _labels(df, self.target)
        if len(classes) < 2:
            raise InsufficientSamples("fewer than two classes")
        own = classes[1:] if len(classes) == 2 else classes
        forms = [self._solve(df, F.when(F.col(self.target) == F.lit(c), 1.0).when(F.col(self.target).isNotNull(), -1.0)).expression() for c in own]
        return _columns_of([-forms[0], forms[0]] if len(classes) == 2 else forms, classes, self.output)


class Perceptron(SGDClassifier):
    loss = "perceptron"

    def __init__(self, *args, alpha: float = 0.0, rate: float = 1.0, **kwargs):
        super().__init__(*args, alpha=alpha, rate=rate, **kwargs)


class PassiveAggressiveClassifier(SGDClassifier):
    """Steps of the least change that mends a row's margin, at most C."""

    def __init__(self, *args, C: float = 1.0, **kwargs):  # noqa: N803
        super().__init__(*args, **kwargs)
        self.passive = C


class PassiveAggressiveRegressor(SGDRegressor):
    loss = "epsilon_insensitive"

    def __init__(self, *args, C: float = 1.0, **kwargs):  # noqa: N803
        super().__init__(*args, **kwargs)
        self.passive = C


class RANSACRegressor(Estimator):
    """Least squares on the rows that agree with the best of many lines through few rows.

    `trials` samples of `sample` rows are drawn by a hash of the key (a bounded number of rows); the inliers of all trials are
    counted in one job. The threshold is the median absolute deviation of the target if not given.
    """

    def __init__(self, columns: Sequence[str], target: str, key: Sequence[str], output: str = "prediction", threshold: float | None = None, trials: int = 50, sample: int | None = None, seed: int = 0):
        self.columns, self.target, self.key, self.output, self.threshold, self.trials, self.seed = list(columns), target, list(key), output, threshold, trials, seed
        self.sample = sample or len(self.columns) + 1

    def fit(self, df: DataFrame) -> LinearModel:
        y = value(self.target)
        full = df.where(y.isNotNull())
        for c in self.columns:
            full = full.where(value(c).isNotNull())
        order = F.xxhash64(F.lit(self.seed), *self.key)
        rows = full.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns)], y.alias("y"), order.alias("o")).orderBy("o", "y").limit(self.trials * self.sample).collect()
        if len(rows) < self.sample:
            raise InsufficientSamples("fewer rows than a sample needs")
        threshold = self.threshold
        if threshold is None:
            middle = full.agg(F.percentile_approx(y, 0.5, 100_000)).first()[0]
            threshold = full.agg(F.percentile_approx(F.abs(y - F.lit(middle)), 0.5, 100_000)).first()[0]
        models = []
        for k in range(len(rows) // self.sample):
            m = np.array([list(r)[:-1] for r in rows[k * self.sample : (k + 1) * self.sample]], float)
            b = np.linalg.lstsq(np.column_stack([m[:, :-1], np.ones(len(m))]), m[:, -1], rcond=1e-12)[0]
            models.append(LinearModel(self.columns, b[:-1], b[-1], self.output))
        near = [F.abs(y - m.expression()) <= float(threshold) for m in models]
        counts = full.agg(*[F.count(F.when(c, 1)) for c in near]).first()
        best = int(np.argmax(counts))
        self.inliers = counts[best]
        return LinearRegression(self.columns, self.target, self.output).fit(full.where(near[best]))


class IsotonicRegression(Estimator):
    """The nearest rising (or falling) step function of one column, linear between its steps.

    Rows are added up by the column's value; each range of values is pooled by its own task, and the pools of all
    ranges are pooled again on the driver: at most `most_pools` of them, else an error.
    """

    def __init__(self, column: str, target: str, output: str = "prediction", increasing: bool = True, weight: str | None = None, most_pools: int = 1_000_000):
        self.column, self.target, self.output, self.increasing, self.weight, self.most_pools = column, target, output, increasing, weight, most_pools

    def fit(self, df: DataFrame) -> Model:
        sign = 1.0 if self.increasing else -1.0
        w = value(self.weight) if self.weight else F.lit(1.0)
        rows = df.select(value(self.column).alias("x"), (value(self.target) * sign).alias("y"), w.alias("w")).dropna()
        sums = rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).where("w > 0")

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pools: list[list[float]] = []
            for batch in batches:
                for x, weight, total in zip(*[batch.column(c).to_pylist() for c in ("x", "w", "wy")], strict=True):
                    pooled(pools, [x, x, weight, total])
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pools], pa.float64()) for i in range(4)], ["low", "high", "w", "wy"])

        ranged = sums.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(pool, "low double, high double, w double, wy double")
        found = ranged.limit(self.most_pools + 1).collect()
        if len(found) > self.most_pools:
            raise InvalidParameter(f"more than {self.most_pools} pools")
        if not found:
            raise InsufficientSamples("no rows to fit on")
        pools: list[list[float]] = []
        for r in sorted(found, key=lambda r: r["low"]):
            pooled(pools, list(r))
        xs = [x for p in pools for x in ((p[0], p[1]) if p[1] > p[0] else (p[0],))]
        ys = [sign * p[3] / p[2] for p in pools for _ in ((0, 1) if p[1] > p[0] else (0,))]
        return Interpolation(self.column, xs, ys, self.output)


def pooled(pools: list[list[float]], new: list[float]) -> None:
    """Adds a pool (low, high, weight, weighted sum) and joins pools until their means rise."""
    pools.append(new)
    while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
        last = pools.pop()
        first = pools[-1]
        pools[-1] = [first[0], last[1], first[2] + last[2], first[3] + last[3]]


class Interpolation(Model):
    """Linear between (x, y) knots, constant beyond."""

    def __init__(self, column: str, xs: Sequence[float], ys: Sequence[float], output: str):
        self.column, self.xs, self.ys, self.output = column, np.array(xs, float), np.array(ys, float), output

    def transform(self, df: DataFrame) -> DataFrame:
        xs, ys = self.xs, self.ys

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return x.where(x.isna(), np.interp(x.to_numpy(), xs, ys))

        return df.withColumn(self.output, run(value(self.column)))


def check_increasing(df: DataFrame, x: str, y: str) -> bool:
    """Whether the rank correlation of x and y isn't negative, ranks taken from approximate quantiles."""
    row = df.agg(F.corr(value(x), value(y))).first()
    return (row[0] or 0.0) >= 0


def isotonic_regression(df: DataFrame, x: str, y: str, increasing: bool = True) -> DataFrame:
    return IsotonicRegression(x, y, increasing=increasing).fit(df).transform(df)


class MultinomialLogisticRegression(Estimator):
    """Any number of classes: softmax of a linear form for each, half the squared weights over C, by Newton steps of one job each."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", C: float = 1.0, max_iter: int = 30, tol: float = 1e-8):  # noqa: N803
        self.columns, self.target, self.output, self.C, self.max_iter, self.tol = list(columns), target, output, C, max_iter, tol

    def fit(self, df: DataFrame) -> ClassScores:
        classes = _labels(df, self.target)
        k, d = len(classes), len(self.columns) + 1
        rows = df.select(F.lit(1.0).alias("x0"), *[value(c).alias(f"x{i}") for i, c in enumerate(self.columns, 1)], (F.array_position(F.lit(classes), F.col(self.target)) - 1).alias("y")).dropna()
        first = rows.agg(*[F.avg(f"x{i}") for i in range(1, d)], *[F.stddev_pop(f"x{i}") for i in range(1, d)]).first()
        at, scale = np.array(first[: d - 1], float), np.array([s or 1.0 for s in first[d - 1 :]], float)
        rows = rows.select("x0", *[((F.col(f"x{i}") - float(at[i - 1])) / float(scale[i - 1])).alias(f"x{i}") for i in range(1, d)], "y")
        b = np.zeros((k, d))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        blocks = [(a, c) for a in range(k) for c in range(a, k)]
        shrink = np.append(0.0, 1 / self.C / scale**2)
        for _ in range(self.max_iter):
            z = [sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(row)), F.lit(0.0)).alias(f"z{c}") for c, row in enumerate(b)]
            top = F.greatest(*[f"z{c}" for c in range(k)]) if k > 1 else F.col("z0")
            stepped = rows.select("*", *z).select("*", top.alias("top"))
            stepped = stepped.select("*", *[F.exp(F.col(f"z{c}") - F.col("top")).alias(f"e{c}") for c in range(k)])
            total = sum((F.col(f"e{c}") for c in range(1, k)), F.col("e0"))
            stepped = stepped.select("y", *[f"x{i}" for i in range(d)], *[(F.col(f"e{c}") / total).alias(f"p{c}") for c in range(k)])
            sums = [F.sum(((F.col("y") == c).cast("double") - F.col(f"p{c}")) * F.col(f"x{i}")) for c in range(k) for i in range(d)]
            sums += [F.sum(F.col(f"p{a}") * ((1.0 if a == c else 0.0) - F.col(f"p{c}")) * F.col(f"x{i}") * F.col(f"x{j}")) for a, c in blocks for i, j in pairs]
            row = stepped.agg(*sums).first()
            g = np.array(row[: k * d], float).reshape(k, d) - shrink * b
            h = np.zeros((k, d, k, d))
            at_ = k * d
            for a, c in blocks:
                for i, j in pairs:
                    for p, q in {(a, c), (c, a)}:
                        h[p, i, q, j] = h[p, j, q, i] = row[at_]
                    at_ += 1
            h = h.reshape(k * d, k * d) + np.diag(np.tile(shrink, k)) + 1e-10 * np.eye(k * d)
            step = np.linalg.lstsq(h, g.reshape(-1), rcond=1e-13)[0].reshape(k, d)
            b = b + step
            if np.abs(step).max() < self.tol:
                break
        w = b[:, 1:] / scale
        self.coefficients, self.intercepts = w, b[:, 0] - w @ at
        return _columns_of([LinearModel(self.columns, w[c], self.intercepts[c], "").expression() for c in range(k)], classes, self.output)


class LogisticRegressionCV(Estimator):
    """MultinomialLogisticRegression with the C of most right predictions over folds by a hash of `key`."""

    def __init__(self, columns: Sequence[str], target: str, key: Sequence[str], output: str = "prediction", Cs: Sequence[float] = (0.01, 1.0, 100.0), folds: int = 3):  # noqa: N803
        self.columns, self.target, self.key, self.output, self.Cs, self.folds = list(columns), target, list(key), output, list(Cs), folds

    def fit(self, df: DataFrame) -> ClassScores:
        fold = fold_of(self.key, self.folds)
        self.scores = []
        for c in self.Cs:
            right = []
            for k in range(self.folds):
                model = MultinomialLogisticRegression(self.columns, self.target, self.output, C=c).fit(df.where(fold != k))
                right.append(model.transform(df.where(fold == k)).agg(F.avg((F.col(self.output) == F.col(self.target)).cast("double"))).first()[0] or 0.0)
            self.scores.append(float(np.mean(right)))
        self.best = self.Cs[int(np.argmax(self.scores))]
        return MultinomialLogisticRegression(self.columns, self.target, self.output, C=self.best).fit(df)

