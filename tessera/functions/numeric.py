"""Scalar functions as column expressions, distributions, integrals, interpolation and minimisers for small problems."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.functions.special import beta_regularised, gamma_upper

# --- one number ---


def gamma(x: float) -> float:
    return math.gamma(x)


def lgamma(x: float) -> float:
    return math.lgamma(x)


def beta(a: float, b: float) -> float:
    return math.exp(lbeta(a, b))


def lbeta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def erf(x: float) -> float:
    return math.erf(x)


def erfc(x: float) -> float:
    return math.erfc(x)


def digamma(x: float) -> float:
    """Derivative of lgamma: reflection below 1/2, recurrence up to 6, then the asymptotic series."""
    if x <= 0 and x == math.floor(x):
        return math.nan
    if x < 0.5:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    q = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q * (1 / 132)))))


def chi2_sf(x: float, df: float) -> float:
    """Share of the chi-squared distribution above x."""
    return gamma_upper(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_test_two_tailed(t: float, df: float) -> float:
    """Chance of a t that is as far from 0."""
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def applied(f: Callable[[float], float], column: Column) -> Column:
    """A function of one number on a column, in Arrow batches; null stays null."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f(v) for v in x], dtype="float64")

    return run(column.cast("double"))


# --- distributions ---


class ContinuousDistribution:
    """pdf, cdf, sf, mean, variance and quantiles by bisection."""

    low, high = -math.inf, math.inf

    def pdf(self, x: float) -> float:
        raise NotImplementedError

    def cdf(self, x: float) -> float:
        raise NotImplementedError

    def sf(self, x: float) -> float:
        return 1 - self.cdf(x)

    def ppf(self, q: float) -> float:
        if not 0 <= q <= 1:
            raise InvalidParameter("a share is from 0 to 1")
        if q in (0, 1):
            return self.high if q else self.low
        a, b = max(self.low, -1.0), min(self.high, 1.0)
        while self.cdf(a) > q and a > self.low:
            a = max(self.low, a * 2)
        while self.cdf(b) < q and b < self.high:
            b = min(self.high, b * 2)
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if self.cdf(m) < q else (a, m)
        return (a + b) / 2


@dataclass(frozen=True)
class Normal(ContinuousDistribution):
    mu: float = 0.0
    sigma: float = 1.0

    def pdf(self, x):
        return math.exp(-0.5 * ((x - self.mu) / self.sigma) ** 2) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x):
        return 0.5 * math.erfc((self.mu - x) / (self.sigma * math.sqrt(2)))

    @property
    def mean(self):
        return self.mu

    @property
    def variance(self):
        return self.sigma**2


@dataclass(frozen=True)
class Gamma(ContinuousDistribution):
    shape: float
    rate: float = 1.0
    low = 0.0

    def pdf(self, x):
        return 0.0 if x < 0 else math.exp(self.shape * math.log(self.rate) + (self.shape - 1) * math.log(max(x, 1e-300)) - self.rate * x - math.lgamma(self.shape))

    def cdf(self, x):
        return 1 - gamma_upper(self.shape, self.rate * x)

    def sf(self, x):
        return gamma_upper(self.shape, self.rate * x)

    @property
    def mean(self):
        return self.shape / self.rate

    @property
    def variance(self):
        return self.shape / self.rate**2


class ChiSquared(Gamma):
    def __init__(self, df: float):
        super().__init__(df / 2, 0.5)


@dataclass(frozen=True)
class Beta(ContinuousDistribution):
    a: float
    b: float
    low, high = 0.0, 1.0

    def pdf(self, x):
        return 0.0 if not 0 < x < 1 else math.exp((self.a - 1) * math.log(x) + (self.b - 1) * math.log1p(-x) - lbeta(self.a, self.b))

    def cdf(self, x):
        return beta_regularised(self.a, self.b, x)

    @property
    def mean(self):
        return self.a / (self.a + self.b)

    @property
    def variance(self):
        return self.a * self.b / ((self.a + self.b) ** 2 * (self.a + self.b + 1))


@dataclass(frozen=True)
class StudentsT(ContinuousDistribution):
    df: float

    def pdf(self, x):
        return math.exp(math.lgamma((self.df + 1) / 2) - math.lgamma(self.df / 2) - 0.5 * math.log(self.df * math.pi) - (self.df + 1) / 2 * math.log1p(x * x / self.df))

    def cdf(self, x):
        tail = 0.5 * t_test_two_tailed(x, self.df)
        return tail if x < 0 else 1 - tail

    @property
    def mean(self):
        return 0.0 if self.df > 1 else math.nan

    @property
    def variance(self):
        return self.df / (self.df - 2) if self.df > 2 else math.inf


@dataclass(frozen=True)
class FDist(ContinuousDistribution):
    d1: float
    d2: float
    low = 0.0

    def pdf(self, x):
        if x <= 0:
            return 0.0
        a, b = self.d1 / 2, self.d2 / 2
        return math.exp(a * math.log(self.d1 / self.d2) + (a - 1) * math.log(x) - (a + b) * math.log1p(self.d1 * x / self.d2) - lbeta(a, b))

    def cdf(self, x):
        return 1 - f_sf(x, self.d1, self.d2)

    @property
    def mean(self):
        return self.d2 / (self.d2 - 2) if self.d2 > 2 else math.nan


@dataclass(frozen=True)
class Dirichlet:
    alpha: tuple[float, ...]

    @property
    def mean(self):
        return [a / sum(self.alpha) for a in self.alpha]

    def pdf(self, x: Sequence[float]) -> float:
        return math.exp(math.lgamma(sum(self.alpha)) - sum(math.lgamma(a) for a in self.alpha) + sum((a - 1) * math.log(v) for a, v in zip(self.alpha, x, strict=True)))

    def sample(self, seed: int) -> list[float]:
        r = random.Random(seed)
        g = [r.gammavariate(a, 1) for a in self.alpha]
        return [v / sum(g) for v in g]


# --- integrals and interpolation ---


def gauss_legendre(f: Callable[[float], float], a: float, b: float, n: int = 20) -> float:
    x, w = np.polynomial.legendre.leggauss(n)
    return float((b - a) / 2 * sum(wi * f((b - a) / 2 * xi + (a + b) / 2) for xi, wi in zip(x, w, strict=True)))


def gauss_legendre_composite(f: Callable[[float], float], a: float, b: float, n: int = 20, pieces: int = 10) -> float:
    edges = np.linspace(a, b, pieces + 1)
    return sum(gauss_legendre(f, lo, hi, n) for lo, hi in zip(edges[:-1], edges[1:], strict=True))


def quad(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10, limit: int = 500) -> tuple[float, float]:
    """(integral, estimated error): the interval of the largest difference between two rules is halved, at most `limit` times."""

    def rule(lo: float, hi: float) -> tuple[float, float, float, float]:
        fine, coarse = gauss_legendre(f, lo, hi, 21), gauss_legendre(f, lo, hi, 10)
        return abs(fine - coarse), fine, lo, hi

    parts = [rule(a, b)]
    for _ in range(limit):
        if sum(p[0] for p in parts) <= tol:
            break
        worst = max(parts)
        parts.remove(worst)
        middle = (worst[2] + worst[3]) / 2
        parts += [rule(worst[2], middle), rule(middle, worst[3])]
    return math.fsum(p[1] for p in parts), math.fsum(p[0] for p in parts)


class CubicSpline:
    """Through (x, y) with continuous second derivatives, 0 at the ends (natural) or with the third derivative continuous
    at the second and last but one knots (not-a-knot)."""

    def __init__(self, x: Sequence[float], y: Sequence[float], boundary: str = "natural"):
        x, y = np.array(x, float), np.array(y, float)
        n = len(x)
        if n < 3 or (np.diff(x) <= 0).any() or boundary == "not-a-knot" and n < 4:
            raise InvalidParameter("three (not-a-knot: four) rising knots at least")
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        m, r = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            r[i] = 6 * (slope[i] - slope[i - 1])
        if boundary == "natural":
            m[0, 0] = m[-1, -1] = 1
        elif boundary == "not-a-knot":
            m[0, :3] = h[1], -(h[0] + h[1]), h[0]
            m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        else:
            raise InvalidParameter("boundary natural or not-a-knot")
        self.x, self.y, self.second = x, y, np.linalg.solve(m, r)

    def __call__(self, at: float, derivative: int = 0) -> float:
        i = int(np.clip(np.searchsorted(self.x, at) - 1, 0, len(self.x) - 2))
        h, a, b = self.x[i + 1] - self.x[i], self.x[i + 1] - at, at - self.x[i]
        p, q = self.second[i], self.second[i + 1]
        if derivative == 0:
            return float((p * a**3 + q * b**3) / (6 * h) + (self.y[i] / h - p * h / 6) * a + (self.y[i + 1] / h - q * h / 6) * b)
        if derivative == 1:
            return float((q * b**2 - p * a**2) / (2 * h) + (self.y[i + 1] - self.y[i]) / h - (q - p) * h / 6)
        return float((p * a + q * b) / h)

    def column(self, c: Column) -> Column:
        return applied(self, c)


# --- minimisers ---


def brent_bounded(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10, most: int = 500) -> tuple[float, float]:
    """(place, value) of a minimum between a and b: parabolas through three points, golden section where they fail."""
    golden = (3 - math.sqrt(5)) / 2
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(most):
        middle, eps = (a + b) / 2, tol * abs(x) + 1e-12
        if abs(x - middle) <= 2 * eps - (b - a) / 2:
            break
        parabola = False
        if abs(last) > eps:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p if q > 0 else p), abs(q)
            if q and abs(p) < abs(0.5 * q * last) and q * (a - x) < p < q * (b - x):
                last, step, parabola = step, p / q, True
        if not parabola:
            last = (b if x < middle else a) - x
            step = golden * last
        u = x + (step if abs(step) >= eps else math.copysign(eps, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def _search(f: Callable, x: np.ndarray, way: np.ndarray, slope: float) -> float:
    """A step that lowers f enough (Armijo), halved until it does."""
    step, start = 1.0, f(x)
    while f(x + step * way) > start + 1e-4 * step * slope and step > 1e-14:
        step /= 2
    return step


class NewtonCG:
    """Newton directions from conjugate gradients on Hessian products, with backtracking."""

    def __init__(self, max_iter: int = 100, tol: float = 1e-8):
        self.max_iter, self.tol = max_iter, tol

    def minimise(self, f: Callable, gradient: Callable, hessian: Callable, x: Sequence[float]) -> np.ndarray:
        """hessian(x, v) is the Hessian at x times v."""
        x = np.array(x, float)
        for _ in range(self.max_iter):
            g = gradient(x)
            size = np.linalg.norm(g)
            if size < self.tol:
                break
            way, r, p = np.zeros_like(x), -g, -g
            for _ in range(10 * len(x)):
                hp = hessian(x, p)
                curve = p @ hp
                if curve <= 0:
                    way = -g if not way.any() else way
                    break
                a = r @ r / curve
                way = way + a * p
                new = r - a * hp
                if np.linalg.norm(new) < min(0.5, math.sqrt(size)) * size:
                    break
                p, r = new + (new @ new) / (r @ r) * p, new
            x = x + _search(f, x, way, g @ way) * way
        return x


class TrustRegionNCG(NewtonCG):
    """Conjugate gradients within a radius that follows how well the quadratic model predicts f."""

    def minimise(self, f, gradient, hessian, x):
        x, radius = np.array(x, float), 1.0
        for _ in range(self.max_iter):
            g = gradient(x)
            if np.linalg.norm(g) < self.tol:
                break
            z, r, p = np.zeros_like(x), g, -g
            for _ in range(10 * len(x)):
                hp = hessian(x, p)
                curve = p @ hp
                a = r @ r / curve if curve > 0 else math.inf
                if curve <= 0 or np.linalg.norm(z + a * p) >= radius:
                    pp, zp = p @ p, z @ p
                    z = z + (-zp + math.sqrt(zp * zp + pp * (radius**2 - z @ z))) / pp * p
                    break
                z, new = z + a * p, r + a * hp
                if np.linalg.norm(new) < 1e-10 * (1 + np.linalg.norm(g)):
                    break
                p, r = -new + (new @ new) / (r @ r) * p, new
            foreseen = -(g @ z + 0.5 * z @ hessian(x, z))
            share = (f(x) - f(x + z)) / foreseen if foreseen > 0 else -1.0
            if share < 0.25:
                radius *= 0.25
            elif share > 0.75 and np.linalg.norm(z) >= 0.99 * radius:
                radius = min(2 * radius, 1e6)
            if share > 1e-4:
                x = x + z
            if radius < 1e-14:
                break
        return x


class Powell:
    """Minima along each of a set of directions in turn, which the moves renew; no derivatives."""

    def __init__(self, max_iter: int = 200, tol: float = 1e-10, reach: float = 10.0):
        self.max_iter, self.tol, self.reach = max_iter, tol, reach

    def minimise(self, f: Callable, x: Sequence[float]) -> np.ndarray:
        x = np.array(x, float)
        ways, fresh = list(np.eye(len(x))), True
        for _ in range(self.max_iter):
            start, before, falls = x.copy(), f(x), []
            for way in ways:
                here = f(x)
                along = lambda t, way=way, x=x: f(x + t * way)
                t, value = min((brent_bounded(along, -self.reach / k, self.reach / k, 1e-12) for k in (1, 10, 100, 1000)), key=lambda found: found[1])
                if value < here:
                    x = x + t * way
                falls.append(here - f(x))
            move = x - start
            if before - f(x) <= self.tol * (1e-10 + abs(before)):
                if fresh:
                    break
                ways, fresh = list(np.eye(len(x))), True  # the directions may have become alike
                continue
            if np.linalg.norm(move) > 0:
                fresh = False
                ways.pop(int(np.argmax(falls)))
                ways.append(move / np.linalg.norm(move))
        return x


class LanczosSolver:
    """Largest eigenvalues of a symmetric matrix from its products with vectors, orthogonalised in full."""

    def __init__(self, k: int, steps: int | None = None, seed: int = 0):
        self.k, self.steps, self.seed = k, steps, seed

    def solve(self, product: Callable[[np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        steps = min(n, self.steps or max(4 * self.k + 20, 40))
        q = np.random.default_rng(self.seed).normal(size=n)
        basis, a, b = [q / np.linalg.norm(q)], [], []
        for _ in range(steps):
            w = product(basis[-1])
            a.append(float(w @ basis[-1]))
            for v in [*basis, *basis]:
                w = w - (w @ v) * v
            size = float(np.linalg.norm(w))
            if size < 1e-10 or len(a) == steps:
                break
            b.append(size)
            basis.append(w / size)
        values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[: len(a) - 1], 1) + np.diag(b[: len(a) - 1], -1))
        order = np.argsort(-values)[: self.k]
        return values[order], np.stack(basis[: len(a)], axis=1) @ vectors[:, order]


def eigsh(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return LanczosSolver(k, steps=len(matrix)).solve(lambda v: matrix @ v, len(matrix))


def posterior_normal_normal(prior_mean: float, prior_var: float, data_mean: float, data_var: float, n: float) -> tuple[float, float]:
    """Mean and variance of a normal mean with a normal prior, after n values of that mean and known variance."""
    precision = 1 / prior_var + n / data_var
    return (prior_mean / prior_var + n * data_mean / data_var) / precision, 1 / precision
