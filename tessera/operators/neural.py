"""Neural networks with hidden layers, and Gaussian processes on a bounded set of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.base import Estimator, Model, Projection, need, value
from tessera.operators.factors import landmarks
from tessera.operators.trees import _labels, _number

ACTIVATIONS = {"relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)), "tanh": (np.tanh, lambda a: 1 - a * a), "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50))), lambda a: a * (1 - a)), "identity": (lambda z: z, np.ones_like)}


def _forward(layers: list, x: np.ndarray, act) -> list[np.ndarray]:
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if k == len(layers) - 1 else act(z))
    return out


class MLPRegressor(Estimator):
    """Hidden layers trained on standardised columns by Adam on full gradients, which tasks add up: one job a step."""

    def __init__(self, columns: Sequence[str], target: str, output: str = "prediction", hidden: Sequence[int] = (16,), activation: str = "relu", alpha: float = 1e-4, rate: float = 0.02, steps: int = 60, seed: int = 0):
        if activation not in ACTIVATIONS:
            raise InvalidParameter(f"unknown activation {activation}")
        self.columns, self.target, self.output, self.hidden, self.activation, self.alpha, self.rate, self.steps, self.seed = list(columns), target, output, list(hidden), activation, alpha, rate, steps, seed

    def head(self, df: DataFrame):
        """(target column, width, loss gradient and final map, classes)"""
        row = df.agg(F.avg(value(self.target)), F.stddev_pop(value(self.target))).first()
        at, scale = row[0] or 0.0, row[1] or 1.0
        return (value(self.target) - at) / scale, 1, lambda z, y: z - y[:, None], lambda z: z[:, 0] * scale + at, None

    def fit(self, df: DataFrame) -> Network:
        need(df, [*self.columns, self.target])
        df = df.where(F.col(self.target).isNotNull())
        y, width, gradient, final, classes = self.head(df)
        d = len(self.columns)
        rows = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns)], y.cast("double").alias("y")).dropna().cache()
        first = rows.agg(F.count("*"), *[F.avg(f"x{i}") for i in range(d)], *[F.stddev_pop(f"x{i}") for i in range(d)]).first()
        if not first[0]:
            raise InsufficientSamples("no rows to fit on")
        n, at, scale = first[0], np.array(first[1 : d + 1], float), np.array([s or 1.0 for s in first[d + 1 :]], float)
        r = np.random.default_rng(self.seed)
        sizes = [d, *self.hidden, width]
        flat = np.concatenate([np.append(r.normal(size=a * b) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])
        act, slope = ACTIVATIONS[self.activation]

        def unpacked(v: np.ndarray) -> list:
            out, k = [], 0
            for a, b in zip(sizes[:-1], sizes[1:], strict=True):
                out.append((v[k : k + a * b].reshape(a, b), v[k + a * b : k + a * b + b]))
                k += a * b + b
            return out

        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, self.steps + 1):

            def add(batches: Iterator[pa.RecordBatch], now=flat) -> Iterator[pa.RecordBatch]:
                layers, total = unpacked(now), np.zeros(len(now))
                for batch in batches:
                    t = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
                    outs = _forward(layers, (t[:, :d] - at) / scale, act)
                    g, parts = gradient(outs[-1], t[:, d]), []
                    for k in range(len(layers) - 1, -1, -1):
                        parts.append(np.append((outs[k].T @ g).reshape(-1), g.sum(axis=0)))
                        if k:
                            g = (g @ layers[k][0].T) * slope(outs[k])
                    total += np.concatenate(parts[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "g"])

            found = rows.mapInArrow(add, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
            g = found / n + self.alpha * flat
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rows.unpersist()
        return Network(self.columns, at, scale, unpacked(flat), self.activation, final, classes, self.output)


class MLPClassifier(MLPRegressor):
    """Softmax of the last layer; adds the label and an array of probabilities."""

    def head(self, df):
        classes = _labels(df, self.target)

        def shares(z: np.ndarray) -> np.ndarray:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return _number(self.target, classes), len(classes), lambda z, y: shares(z) - (y[:, None] == np.arange(z.shape[1])), shares, classes


class Network(Model):
    def __init__(self, columns, at, scale, layers, activation, final, classes, output):
        self.columns, self.at, self.scale, self.layers, self.activation, self.final, self.classes, self.output = columns, at, scale, layers, activation, final, classes, output

    def transform(self, df: DataFrame) -> DataFrame:
        at, scale, layers, act, final, d = self.at, self.scale, self.layers, ACTIVATIONS[self.activation][0], self.final, len(self.columns)
        several = self.classes is not None

        @F.pandas_udf("array<double>" if several else "double")
        def run(x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), float).reshape(len(x), d)
            found = final(_forward(layers, (rows - at) / scale, act)[-1])
            return pd.Series(list(found) if several else found)

        out = run(F.array(*[value(c) for c in self.columns]))
        if not several:
            return df.withColumn(self.output, out)
        chance = f"{self.output}_probability"
        best = F.array_position(F.col(chance), F.array_max(chance)).cast("int")
        return df.withColumn(chance, out).withColumn(self.output, F.element_at(F.lit(list(self.classes)), best))


# --- kernels of Gaussian processes: functions of two row matrices that can be added, multiplied and raised ---


class GPKernel:
    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def __add__(self, other: GPKernel) -> GPKernel:
        return _Pair(self, other, np.add)

    def __mul__(self, other: GPKernel) -> GPKernel:
        return _Pair(self, other, np.multiply)

    def __pow__(self, power: float) -> GPKernel:
        return _Power(self, power)


class _Pair(GPKernel):
    def __init__(self, first: GPKernel, second: GPKernel, join):
        self.first, self.second, self.join = first, second, join

    def __call__(self, a, b):
        return self.join(self.first(a, b), self.second(a, b))


class _Power(GPKernel):
    def __init__(self, inner: GPKernel, power: float):
        self.inner, self.power = inner, power

    def __call__(self, a, b):
        return self.inner(a, b) ** self.power


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


class RBFKernel(GPKernel):
    def __init__(self, length: float = 1.0):
        self.length = length

    def __call__(self, a, b):
        return np.exp(-0.5 * (_far(a, b) / self.length) ** 2)


class MaternKernel(GPKernel):
    """nu 0.5, 1.5 or 2.5."""

    def __init__(self, length: float = 1.0, nu: float = 1.5):
        if nu not in (0.5, 1.5, 2.5):
            raise InvalidParameter("nu 0.5, 1.5 or 2.5")
        self.length, self.nu = length, nu

    def __call__(self, a, b):
        u = np.sqrt(2 * self.nu) * _far(a, b) / self.length
        return np.exp(-u) * {0.5: 1.0, 1.5: 1 + u, 2.5: 1 + u + u * u / 3}[self.nu]


class RationalQuadratic(GPKernel):
    def __init__(self, length: float = 1.0, alpha: float = 1.0):
        self.length, self.alpha = length, alpha

    def __call__(self, a, b):
        return (1 + _far(a, b) ** 2 / (2 * self.alpha * self.length**2)) ** -self.alpha


class ExpSineSquared(GPKernel):
    def __init__(self, length: float = 1.0, period: float = 1.0):
        self.length, self.period = length, period

    def __call__(self, a, b):
        return np.exp(-2 * (np.sin(np.pi * _far(a, b) / self.period) / self.length) ** 2)


class ConstantKernel(GPKernel):
    def __init__(self, constant: float = 1.0):
        self.constant = constant

    def __call__(self, a, b):
        return np.full((len(a), len(b)), self.constant)


class WhiteKernel(GPKernel):
    """Noise: counts where both matrices are the same."""

    def __init__(self, noise: float = 1.0):
        self.noise = noise

    def __call__(self, a, b):
        return self.noise * np.eye(len(a)) if a is b else np.zeros((len(a), len(b)))


class DotProductKernel(GPKernel):
    def __init__(self, sigma: float = 1.0):
        self.sigma = sigma

    def __call__(self, a, b):
        return a @ b.T + self.sigma**2


class GaussianProcessRegressor(Estimator):
    """Mean and standard deviation of a process given at most `most_rows` rows (in order of a hash of the key)."""

    def __init__(self, columns: Sequence[str], target: str, key: Sequence[str], kernel: GPKernel | None = None, alpha: float = 1e-10, most_rows: int = 1000, output: str = "prediction", seed: int = 0):
        self.columns, self.target, self.key, self.kernel, self.alpha, self.most_rows, self.output, self.seed = list(columns), target, list(key), kernel or RBFKernel(), alpha, most_rows, output, seed

    def fit(self, df: DataFrame) -> Projection:
        rows = landmarks(df, [*self.columns, self.target], self.key, self.most_rows, self.seed)
        x, y, d, kernel = rows[:, :-1], rows[:, -1], len(self.columns), self.kernel
        k = kernel(x, x) + self.alpha * np.eye(len(x))
        dual, inverse = np.linalg.solve(k, y), np.linalg.inv(k)
        self.log_likelihood = float(-0.5 * y @ dual - 0.5 * np.linalg.slogdet(k)[1] - 0.5 * len(y) * np.log(2 * np.pi))

        @F.pandas_udf("array<double>")
        def run(t: pd.Series) -> pd.Series:
            at = np.array(t.tolist(), float).reshape(len(t), d)
            met = kernel(at, x)
            own = np.array([kernel(r, r)[0, 0] for r in (at[i : i + 1] for i in range(len(at)))])
            spread = np.sqrt(np.maximum(own - ((met @ inverse) * met).sum(axis=1), 0))
            return pd.Series(list(np.stack([met @ dual, spread], axis=1)))

        found = run(F.array(*[value(c) for c in self.columns]))
        return Projection({self.output: found[0], f"{self.output}_std": found[1]}, self.columns)
