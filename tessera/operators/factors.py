"""Factorisations, covariances and random features from Gram matrices and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.base import Estimator, Projection, need, value
from tessera.operators.decomposition import EmpiricalCovariance, ShrunkCovariance
from tessera.operators.linear import gram
from tessera.operators.regression import Moments, MultiLinearModel, LinearModel, merged


def _scores(columns: Sequence[str], mean: np.ndarray, axes: np.ndarray, prefix: str) -> Projection:
    """Linear scores (x - mean) @ axes.T as columns prefix1, prefix2 and so on."""
    out = {}
    for k, axis in enumerate(axes, 1):
        terms = [(value(c) - F.lit(float(m))) * F.lit(float(a)) for c, m, a in zip(columns, mean, axis, strict=True)]
        out[f"{prefix}{k}"] = sum(terms[1:], terms[0])
    return Projection(out, columns)


def _signed(axes: np.ndarray) -> np.ndarray:
    """Axes turned so that their largest entry is positive."""
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


class TruncatedSVD(Estimator):
    """Scores on the right singular vectors of the columns as they are, not centred."""

    def __init__(self, columns: Sequence[str], n_components: int = 2, prefix: str = "svd"):
        self.columns, self.n_components, self.prefix = list(columns), n_components, prefix

    def fit(self, df: DataFrame) -> Projection:
        n, mean, p = gram(df, self.columns)
        values, vectors = np.linalg.eigh(p + n * np.outer(mean, mean))
        order = np.argsort(-values)[: self.n_components]
        self.singular_values, self.components = np.sqrt(np.maximum(values[order], 0)), _signed(vectors[:, order].T)
        return _scores(self.columns, np.zeros(len(mean)), self.components, self.prefix)


class IncrementalPCA(Estimator):
    """PCA of all batches so far: partial_fit merges a batch's Gram matrix into what is kept."""

    def __init__(self, columns: Sequence[str], n_components: int = 2):
        self.columns, self.n_components = list(columns), n_components
        self.seen: Moments | None = None

    def partial_fit(self, df: DataFrame) -> Projection:
        new = gram(df, self.columns)
        self.seen = new if self.seen is None else merged([self.seen, new])
        n, mean, p = self.seen
        values, vectors = np.linalg.eigh(p / max(n - 1, 1))
        order = np.argsort(-values)[: self.n_components]
        self.explained_variance, self.components = values[order], _signed(vectors[:, order].T)
        return _scores(self.columns, mean, self.components, "pc")

    def fit(self, df: DataFrame) -> Projection:
        self.seen = None
        return self.partial_fit(df)


class FactorAnalysis(Estimator):
    """Loadings and a noise variance for each column, by expectation maximisation on the covariance; scores are the factors' means."""

    def __init__(self, columns: Sequence[str], n_components: int = 1, max_iter: int = 1000, tol: float = 1e-8):
        self.columns, self.n_components, self.max_iter, self.tol = list(columns), n_components, max_iter, tol

    def fit(self, df: DataFrame) -> Projection:
        n, mean, p = gram(df, self.columns)
        s, k = p / n, self.n_components
        values, vectors = np.linalg.eigh(s)
        w = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:], 1e-12))
        psi = np.maximum(np.diag(s - w @ w.T), 1e-6 * np.diag(s) + 1e-12)
        last = -np.inf
        for _ in range(self.max_iter):
            m = np.linalg.inv(np.eye(k) + (w.T / psi) @ w)
            b = m @ (w.T / psi)
            sb = s @ b.T
            w = sb @ np.linalg.inv(m + b @ sb)
            psi = np.maximum(np.diag(s - w @ (b @ s)), 1e-12)
            full = w @ w.T + np.diag(psi)
            now = -0.5 * (np.linalg.slogdet(full)[1] + np.trace(np.linalg.solve(full, s)))
            if abs(now - last) < self.tol:
                break
            last = now
        self.loadings, self.noise, self.log_likelihood = _signed(w.T), psi, n * (now - 0.5 * len(mean) * math.log(2 * math.pi))
        w = self.loadings.T
        return _scores(self.columns, mean, np.linalg.inv(np.eye(k) + (w.T / psi) @ w) @ (w.T / psi), "factor")


class FastICA(Estimator):
    """Independent components: whitened by the covariance, then fixed-point steps with tanh, one aggregate job each."""

    def __init__(self, columns: Sequence[str], n_components: int = 2, max_iter: int = 50, tol: float = 1e-6, seed: int = 0):
        self.columns, self.n_components, self.max_iter, self.tol, self.seed = list(columns), n_components, max_iter, tol, seed

    def fit(self, df: DataFrame) -> Projection:
        n, mean, p = gram(df, self.columns)
        values, vectors = np.linalg.eigh(p / n)
        order = np.argsort(-values)[: self.n_components]
        white = vectors[:, order].T / np.sqrt(values[order])[:, None]
        k = len(white)
        rows = _scores(self.columns, mean, white, "__w").transform(df).select(*[F.col(f"__w{i + 1}").alias(f"z{i}") for i in range(k)]).dropna()
        w = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(k, k)))[0]
        for _ in range(self.max_iter):
            s = rows.select("*", *[F.tanh(sum((F.lit(float(v)) * F.col(f"z{i}") for i, v in enumerate(r)), F.lit(0.0))).alias(f"g{j}") for j, r in enumerate(w)])
            row = s.agg(*[F.avg(F.col(f"g{j}") * F.col(f"z{i}")) for j in range(k) for i in range(k)], *[F.avg(1 - F.col(f"g{j}") ** 2) for j in range(k)]).first()
            new = np.array(row[: k * k]).reshape(k, k) - np.array(row[k * k :])[:, None] * w
            u, _, v = np.linalg.svd(new)
            new = u @ v
            done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < self.tol
            w = new
            if done:
                break
        self.components = w @ white
        return _scores(self.columns, mean, self.components, "ic")


class PLSRegression(Estimator):
    """Partial least squares for several targets, on standardised columns, all from one Gram matrix.

    deflate "regression" takes the x scores' part out of the targets, "canonical" the y scores' own. mode "B" uses inverse
    covariances, which gives canonical correlations.
    """

    deflate, mode = "regression", "A"

    def __init__(self, columns: Sequence[str], targets: Sequence[str], n_components: int = 2, max_iter: int = 500, tol: float = 1e-10):
        self.columns, self.targets, self.n_components, self.max_iter, self.tol = list(columns), list(targets), n_components, max_iter, tol

    def fit(self, df: DataFrame) -> MultiLinearModel:
        n, mean, p = gram(df, [*self.columns, *self.targets])
        d = len(self.columns)
        scale = np.sqrt(np.diag(p) / max(n - 1, 1))
        scale[scale == 0] = 1
        c = p / np.outer(scale, scale)
        xx, xy, yy = c[:d, :d].copy(), c[:d, d:].copy(), c[d:, d:].copy()
        ws, ps, qs, vs = [], [], [], []
        for _ in range(self.n_components):
            if self.mode == "B":
                w = np.linalg.svd(_root(xx) @ xy @ _root(yy))[0][:, 0]
                w = _root(xx) @ w
                v = np.linalg.pinv(yy) @ xy.T @ w
            else:
                u, _, vt = np.linalg.svd(xy)
                w, v = u[:, 0], vt[0]
            sign = np.sign(w[np.abs(w).argmax()])
            w, v = w * sign / np.linalg.norm(w), v * sign / max(np.linalg.norm(v), 1e-300)
            tt = w @ xx @ w
            if tt < 1e-12 * n:
                break
            px = xx @ w / tt
            qy = xy.T @ w / tt if self.deflate == "regression" else yy @ v / max(v @ yy @ v, 1e-300)
            left = np.eye(d) - np.outer(w, px)  # x rows times this are what is left of them
            if self.deflate == "regression":
                xy = left.T @ xy - left.T @ np.outer(xx @ w, qy)
            else:
                right = np.eye(len(qy)) - np.outer(v, qy)
                xy, yy = left.T @ xy @ right, right.T @ yy @ right
            xx = left.T @ xx @ left
            ws.append(w), ps.append(px), qs.append(qy), vs.append(v)
        w, px = np.array(ws).T, np.array(ps).T
        self.rotations = w @ np.linalg.pinv(px.T @ w)
        self.x_weights, self.y_weights = w, np.array(vs).T
        if self.deflate == "regression":
            b = self.rotations @ np.array(qs)
        else:
            b = self.rotations @ np.linalg.lstsq(self.rotations.T @ c[:d, :d] @ self.rotations, self.rotations.T @ c[:d, d:], rcond=1e-12)[0]
        b = b / scale[:d, None] * scale[None, d:]
        self.coefficients, self.means, self.scale = b, mean, scale
        return MultiLinearModel([LinearModel(self.columns, b[:, t], float(mean[d + t] - mean[:d] @ b[:, t]), f"{name}_prediction") for t, name in enumerate(self.targets)])

    def scores(self) -> Projection:
        """The columns' scores, after fit."""
        d = len(self.columns)
        return _scores(self.columns, self.means[:d], (self.rotations / self.scale[:d, None]).T, "pls")


def _root(m: np.ndarray) -> np.ndarray:
    """The inverse square root of a covariance."""
    values, vectors = np.linalg.eigh(m)
    good = values > 1e-10 * max(values.max(), 1e-300)
    return (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T


class PLSCanonical(PLSRegression):
    deflate = "canonical"


class CCA(PLSCanonical):
    mode = "B"


class PLSSVD(Estimator):
    """Scores on the singular vectors of the cross products of standardised columns and targets."""

    def __init__(self, columns: Sequence[str], targets: Sequence[str], n_components: int = 1):
        self.columns, self.targets, self.n_components = list(columns), list(targets), n_components

    def fit(self, df: DataFrame) -> Projection:
        n, mean, p = gram(df, [*self.columns, *self.targets])
        d = len(self.columns)
        scale = np.sqrt(np.maximum(np.diag(p) / max(n - 1, 1), 1e-300))
        u, _, _ = np.linalg.svd((p / np.outer(scale, scale))[:d, d:])
        return _scores(self.columns, mean[:d], _signed(u[:, : self.n_components].T) / scale[None, :d], "pls")


class NMF(Estimator):
    """Nonnegative factors of nonnegative columns: rows' weights follow from the factors by few multiplicative steps as an
    expression, the factors from two sums over the rows, one job a step. Starts from the seed."""

    def __init__(self, columns: Sequence[str], n_components: int = 2, max_iter: int = 50, inner: int = 10, tol: float = 1e-5, seed: int = 0):
        self.columns, self.n_components, self.max_iter, self.inner, self.tol, self.seed = list(columns), n_components, max_iter, inner, tol, seed

    def weights(self, h: np.ndarray):
        """A vectorised function from rows to their weights."""
        steps, hh = self.inner * 10, h @ h.T

        def solve(x: np.ndarray) -> np.ndarray:
            w = np.full((len(x), len(h)), max(float(x.mean()), 1e-12) if x.size else 0.0)
            xh = x @ h.T
            for _ in range(steps):
                w *= xh / np.maximum(w @ hh, 1e-300)
            return w

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(solve(np.array(x.tolist(), float).reshape(len(x), h.shape[1]))))

        return run

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        row = df.agg(F.count("*"), *[F.min(value(c)) for c in self.columns], *[F.avg(value(c)) for c in self.columns]).first()
        d, k = len(self.columns), self.n_components
        if not row[0]:
            raise InsufficientSamples("no rows to fit on")
        if min(row[1 : d + 1]) < 0:
            raise InvalidParameter("columns must not be negative")
        x = F.array(*[value(c) for c in self.columns])
        rows = df.select(x.alias("x"), *[value(c).alias(f"x{j}") for j, c in enumerate(self.columns)]).dropna()
        h = np.random.default_rng(self.seed).uniform(0.5, 1.5, (k, d)) * np.array(row[d + 1 :])[None, :]
        for _ in range(self.max_iter):
            w = rows.withColumn("w", self.weights(h)("x"))
            sums = w.agg(*[F.sum(F.col("w")[i] * F.col(f"x{j}")) for i in range(k) for j in range(d)], *[F.sum(F.col("w")[i] * F.col("w")[j]) for i in range(k) for j in range(k)]).first()
            wx, ww = np.array(sums[: k * d]).reshape(k, d), np.array(sums[k * d :]).reshape(k, k)
            before = h.copy()
            for _ in range(self.inner):
                h = h * wx / np.maximum(ww @ h, 1e-300)
            if np.abs(h - before).max() <= self.tol * np.abs(h).max():
                break
        self.components = h
        run = self.weights(h)
        return Projection({"nmf": run(x)}, self.columns)


# --- covariances ---


class OAS(ShrunkCovariance):
    """ShrunkCovariance whose share is the oracle-approximating one."""

    def shrunk(self, covariance, df, n):
        self.shrinkage = oas_shrinkage(covariance, n)
        return super().shrunk(covariance, df, n)


def oas_shrinkage(covariance: np.ndarray, n: float) -> float:
    p = len(covariance)
    alpha, mu = float((covariance**2).mean()), np.trace(covariance) / p
    top, bottom = alpha + mu**2, (n + 1) * (alpha - mu**2 / p)
    return 1.0 if bottom == 0 else min(top / bottom, 1.0)


def oas(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, float]:
    fitted = OAS(columns).fit(df)
    return fitted.covariance, fitted.shrinkage


def ledoit_wolf_shrinkage(df: DataFrame, columns: Sequence[str]) -> float:
    from tessera.operators.decomposition import LedoitWolf

    return LedoitWolf(columns).fit(df).shrinkage


def log_likelihood(covariance: np.ndarray, precision: np.ndarray) -> float:
    """The mean Gaussian log-likelihood of rows of that covariance under a precision."""
    p = len(precision)
    return float((-np.sum(covariance * precision) + np.linalg.slogdet(precision)[1] - p * math.log(2 * math.pi)) / 2)


def graphical_lasso(covariance: np.ndarray, alpha: float, max_iter: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) with penalty alpha on the precision's entries off the diagonal: each column by a lasso."""
    s = np.array(covariance, float)
    w, p = s.copy(), len(s)
    b = np.zeros((p, p))
    if alpha > 0:
        w = 0.95 * w + 0.05 * np.diag(np.diag(s))
        w[np.diag_indices(p)] = np.diag(s)
        for _ in range(max_iter):
            before = w.copy()
            for j in range(p):
                rest = [i for i in range(p) if i != j]
                g, c, x = w[np.ix_(rest, rest)], s[rest, j], b[rest, j].copy()
                for _ in range(500):
                    old = x.copy()
                    for i in range(p - 1):
                        r = c[i] - g[i] @ x + g[i, i] * x[i]
                        x[i] = np.sign(r) * max(abs(r) - alpha, 0) / g[i, i]
                    if np.abs(x - old).max() < 1e-10:
                        break
                b[rest, j] = x
                w[rest, j] = w[j, rest] = g @ x
            if np.abs(w - before).mean() < tol * np.abs(s).mean():
                break
    return w, np.linalg.inv(w)


class GraphicalLasso(EmpiricalCovariance):
    def __init__(self, columns: Sequence[str], alpha: float = 0.01):
        super().__init__(columns)
        self.alpha = alpha

    def shrunk(self, covariance, df, n):
        out, self.precision = graphical_lasso(covariance, self.alpha)
        return out


class GraphicalLassoCV(GraphicalLasso):
    """alpha by the likelihood of held-out folds (a hash of `key`), from the folds' Gram matrices."""

    def __init__(self, columns: Sequence[str], key: Sequence[str], alphas: Sequence[float] = (0.01, 0.1, 1.0), folds: int = 4):
        super().__init__(columns)
        self.key, self.alphas, self.folds = list(key), list(alphas), folds

    def fit(self, df: DataFrame) -> GraphicalLassoCV:
        from tessera.operators.regression import fold_of, grams

        parts = list(grams(df, self.columns, fold_of(self.key, self.folds)).values())
        worth = []
        for alpha in self.alphas:
            total = 0.0
            for part in parts:
                n, mean, p = merged([q for q in parts if q is not part])
                precision = graphical_lasso(p / n, alpha)[1]
                off = part[1] - mean
                total += log_likelihood(part[2] / part[0] + np.outer(off, off), precision)
            worth.append(total)
        self.alpha = self.alphas[int(np.argmax(worth))]
        return super().fit(df)


class MinCovDet(EmpiricalCovariance):
    """Location and covariance of the `share` of rows nearest to them: concentration steps from all rows, each one quantile and
    one Gram job, then a correction by the median distance and a step over the rows within the 97.5 % quantile."""

    def __init__(self, columns: Sequence[str], share: float = 0.75, max_iter: int = 30):
        super().__init__(columns)
        self.share, self.max_iter = share, max_iter

    def _within(self, df: DataFrame, cut: float) -> None:
        near = self.mahalanobis(df, "__d").where(F.col("__d") <= cut)
        n, self.location, p = gram(near, self.columns)
        self.covariance = p / max(n, 1)

    def fit(self, df: DataFrame) -> MinCovDet:
        from tessera.functions.numeric import ChiSquared

        super().fit(df)
        at = lambda q: self.mahalanobis(df, "__d").agg(F.percentile_approx("__d", q, 100_000)).first()[0]
        last = np.inf
        for _ in range(self.max_iter):
            self._within(df, at(self.share))
            now = np.linalg.slogdet(self.covariance)[1]
            if last - now < 1e-9:
                break
            last = now
        law = ChiSquared(len(self.columns))
        self.covariance = self.covariance * at(0.5) / law.ppf(0.5)
        self._within(df, law.ppf(0.975))
        return self


def fast_mcd(df: DataFrame, columns: Sequence[str], share: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    found = MinCovDet(columns, share).fit(df)
    return found.location, found.covariance


class EllipticEnvelope(MinCovDet):
    """MinCovDet, and -1 for the `contamination` of rows that are farthest, 1 for the others."""

    def __init__(self, columns: Sequence[str], contamination: float = 0.1, **options):
        super().__init__(columns, **options)
        self.contamination = contamination

    def fit(self, df: DataFrame) -> EllipticEnvelope:
        super().fit(df)
        self.offset = self.mahalanobis(df, "__d").agg(F.percentile_approx("__d", 1 - self.contamination, 100_000)).first()[0]
        return self

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.mahalanobis(df, "__d").withColumn(output, F.when(F.col("__d") > self.offset, -1).otherwise(1)).drop("__d")


# --- random features ---


def johnson_lindenstrauss_min_dim(n: int, eps: float = 0.1) -> int:
    """Dimensions that keep distances of n points within 1 +- eps."""
    if not 0 < eps < 1 or n < 1:
        raise InvalidParameter("eps between 0 and 1, n from 1")
    return int(4 * math.log(n) / (eps**2 / 2 - eps**3 / 3))


class GaussianRandomProjection(Estimator):
    """Columns p1, p2 and so on: products with normal numbers of variance 1 / n_components."""

    def __init__(self, columns: Sequence[str], n_components: int, seed: int = 0):
        self.columns, self.n_components, self.seed = list(columns), n_components, seed

    def matrix(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.n_components, len(self.columns))) / math.sqrt(self.n_components)

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        return _scores(self.columns, np.zeros(len(self.columns)), self.matrix(), "p")


class SparseRandomProjection(GaussianRandomProjection):
    """Entries 0 but for a share `density`, which are +-sqrt(1 / density / n_components)."""

    def __init__(self, columns: Sequence[str], n_components: int, density: float | None = None, seed: int = 0):
        super().__init__(columns, n_components, seed)
        self.density = density or 1 / math.sqrt(len(self.columns))

    def matrix(self):
        r = np.random.default_rng(self.seed)
        shape = (self.n_components, len(self.columns))
        return np.where(r.random(shape) < self.density, r.choice([-1.0, 1.0], shape), 0.0) / math.sqrt(self.density * self.n_components)


class RBFSampler(Estimator):
    """sqrt(2 / n) cos(w x + b): inner products approach exp(-gamma |x - y|^2)."""

    def __init__(self, columns: Sequence[str], gamma: float = 1.0, n_components: int = 100, seed: int = 0):
        self.columns, self.gamma, self.n_components, self.seed = list(columns), gamma, n_components, seed

    def draw(self, r: np.random.Generator) -> np.ndarray:
        return r.normal(size=(self.n_components, len(self.columns))) * math.sqrt(2 * self.gamma)

    def mapped(self, c: str) -> Column:
        return value(c)

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        r = np.random.default_rng(self.seed)
        w, b = self.draw(r), r.uniform(0, 2 * math.pi, self.n_components)
        out = {}
        for k in range(self.n_components):
            form = sum((self.mapped(c) * F.lit(float(v)) for c, v in zip(self.columns, w[k], strict=True)), F.lit(float(b[k])))
            out[f"f{k + 1}"] = F.cos(form) * F.lit(math.sqrt(2 / self.n_components))
        return Projection(out, self.columns)


class SkewedChi2Sampler(RBFSampler):
    """The same for the skewed chi-squared kernel: logarithms of x + skewedness, weights by the hyperbolic secant."""

    def __init__(self, columns: Sequence[str], skewedness: float = 1.0, n_components: int = 100, seed: int = 0):
        super().__init__(columns, 1.0, n_components, seed)
        self.skewedness = skewedness

    def draw(self, r):
        return np.log(np.tan(math.pi / 2 * r.uniform(size=(self.n_components, len(self.columns))))) / math.pi

    def mapped(self, c):
        return F.ln(value(c) + self.skewedness)


class AdditiveChi2Sampler(Estimator):
    """2 * sample_steps - 1 columns for each: samples of the additive chi-squared kernel's spectrum."""

    def __init__(self, columns: Sequence[str], sample_steps: int = 2, interval: float | None = None):
        known = {1: 0.8, 2: 0.5, 3: 0.4}
        if interval is None and sample_steps not in known:
            raise InvalidParameter("an interval is needed for more than three steps")
        self.columns, self.steps, self.interval = list(columns), sample_steps, interval or known[sample_steps]

    def fit(self, df: DataFrame) -> Projection:
        out = {}
        for c in self.columns:
            x = value(c)
            out[f"{c}_0"] = F.when(x > 0, F.sqrt(x * self.interval)).otherwise(0.0)
            for j in range(1, self.steps):
                size = F.sqrt(2 * x * self.interval / math.cosh(math.pi * j * self.interval))
                for kind, f in (("cos", F.cos), ("sin", F.sin)):
                    out[f"{c}_{kind}{j}"] = F.when(x > 0, size * f(F.lit(j * self.interval) * F.ln(x))).otherwise(0.0)
        return Projection(out, self.columns)


class PolynomialCountSketch(Estimator):
    """An array whose inner products approach (gamma x.y + coef0) ** degree: count sketches multiplied in the Fourier domain."""

    def __init__(self, columns: Sequence[str], gamma: float = 1.0, degree: int = 2, coef0: float = 0.0, n_components: int = 100, output: str = "sketch", seed: int = 0):
        self.columns, self.gamma, self.degree, self.coef0, self.n_components, self.output, self.seed = list(columns), gamma, degree, coef0, n_components, output, seed

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        r = np.random.default_rng(self.seed)
        d, m, degree, gamma, coef0 = len(self.columns) + 1, self.n_components, self.degree, self.gamma, self.coef0
        place, sign = r.integers(0, m, (degree, d)), r.choice([-1.0, 1.0], (degree, d))

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), float).reshape(len(x), d - 1)
            rows = np.concatenate([rows * math.sqrt(gamma), np.full((len(rows), 1), math.sqrt(coef0))], axis=1)
            product = np.ones((len(rows), m // 2 + 1), complex)
            for k in range(degree):
                sketch = np.zeros((len(rows), m))
                for j in range(d):
                    sketch[:, place[k, j]] += rows[:, j] * sign[k, j]
                product *= np.fft.rfft(sketch, axis=1)
            return pd.Series(list(np.fft.irfft(product, n=m, axis=1)))

        return Projection({self.output: run(F.array(*[value(c) for c in self.columns]))}, self.columns)


def kernel_function(kernel: str, gamma: float, degree: int, coef0: float):
    """A kernel of two row matrices."""
    if kernel == "linear":
        return lambda a, b: a @ b.T
    if kernel == "poly":
        return lambda a, b: (gamma * a @ b.T + coef0) ** degree
    if kernel == "sigmoid":
        return lambda a, b: np.tanh(gamma * a @ b.T + coef0)
    if kernel == "rbf":
        return lambda a, b: np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))
    raise InvalidParameter(f"unknown kernel {kernel}")


def landmarks(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int, seed: int) -> np.ndarray:
    """At most n rows, in the order of a hash of their key."""
    x = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(columns)], F.xxhash64(F.lit(seed), *key).alias("o")).dropna()
    rows = x.orderBy("o", *[f"x{i}" for i in range(len(columns))]).limit(n).drop("o").collect()
    if not rows:
        raise InsufficientSamples("no rows to fit on")
    return np.array([list(r) for r in rows], float)


class Nystroem(Estimator):
    """An array whose inner products approach a kernel: kernels with at most n_components rows, times the root of those rows' own inverse."""

    def __init__(self, columns: Sequence[str], key: Sequence[str], kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 1.0, n_components: int = 100, output: str = "features", seed: int = 0):
        self.columns, self.key, self.n_components, self.output, self.seed = list(columns), list(key), n_components, output, seed
        self.kernel = kernel_function(kernel, gamma, degree, coef0)

    def basis(self, own: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(own)
        values = np.maximum(values, 1e-12)
        return vectors / np.sqrt(values) @ vectors.T

    def fit(self, df: DataFrame) -> Projection:
        at = landmarks(df, self.columns, self.key, self.n_components, self.seed)
        kernel, root, d = self.kernel, self.basis(self.kernel(at, at)), len(self.columns)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(np.array(x.tolist(), float).reshape(len(x), d), at) @ root))

        return Projection({self.output: run(F.array(*[value(c) for c in self.columns]))}, self.columns)


class KernelPCA(Nystroem):
    """Scores on the main axes in a kernel's space, spanned by at most `most_rows` rows; exact if there are no more rows."""

    def __init__(self, columns, key, n_axes: int = 2, most_rows: int = 1000, output: str = "kpca", **options):
        super().__init__(columns, key, n_components=most_rows, output=output, **options)
        self.n_axes = n_axes

    def fit(self, df):
        at = landmarks(df, self.columns, self.key, self.n_components, self.seed)
        kernel, d, k = self.kernel, len(self.columns), self.n_axes
        own = kernel(at, at)
        mean, all_ = own.mean(axis=0), own.mean()
        values, vectors = np.linalg.eigh(own - mean[None, :] - mean[:, None] + all_)
        order = np.argsort(-values)[:k]
        axes = _signed(vectors[:, order].T).T / np.sqrt(np.maximum(values[order], 1e-300))
        self.eigenvalues = values[order]

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            rows = kernel(np.array(x.tolist(), float).reshape(len(x), d), at)
            return pd.Series(list((rows - rows.mean(axis=1, keepdims=True) - mean[None, :] + all_) @ axes))

        return Projection({self.output: run(F.array(*[value(c) for c in self.columns]))}, self.columns)


class KernelRidge(Estimator):
    """Ridge in a kernel's space spanned by at most `most_rows` rows; exact if there are no more rows."""

    def __init__(self, columns: Sequence[str], target: str, key: Sequence[str], alpha: float = 1.0, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 1.0, most_rows: int = 500, output: str = "prediction", seed: int = 0):
        self.columns, self.target, self.key, self.alpha, self.most_rows, self.output, self.seed = list(columns), target, list(key), alpha, most_rows, output, seed
        self.kernel = kernel_function(kernel, gamma, degree, coef0)

    def fit(self, df: DataFrame) -> Projection:
        at = landmarks(df, self.columns, self.key, self.most_rows, self.seed)
        kernel, d, m = self.kernel, len(self.columns), len(at)

        def add(batches):
            kk, ky = np.zeros((m, m)), np.zeros(m)
            for batch in batches:
                rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
                k = kernel(rows[:, :d], at)
                kk += k.T @ k
                ky += k.T @ rows[:, d]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(list(kk)), pa.array(ky)], ["i", "kk", "ky"])

        rows = df.select(*[value(c) for c in [*self.columns, self.target]]).dropna().mapInArrow(add, "i long, kk array<double>, ky double")
        sums = rows.groupBy("i").agg(*[F.sum(F.col("kk")[j]).alias(f"k{j}") for j in range(m)], F.sum("ky").alias("ky")).orderBy("i").collect()
        kk, ky = np.array([list(r)[1 : m + 1] for r in sums]), np.array([r["ky"] for r in sums])
        dual = np.linalg.lstsq(kk + self.alpha * kernel(at, at), ky, rcond=1e-13)[0]

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(kernel(np.array(x.tolist(), float).reshape(len(x), d), at) @ dual)

        return Projection({self.output: run(F.array(*[value(c) for c in self.columns]))}, self.columns)
