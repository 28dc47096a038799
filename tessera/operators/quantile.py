"""Maps of columns by their own distribution."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Projection, need, quantiles, value


class QuantileTransformer(Estimator):
    """Share of the column's distribution below the value, between quantiles linearly; values at or beyond the ends are 0 and 1.

    Where quantiles are equal, the mean of both ends of the flat part is taken.
    """

    def __init__(self, columns: Sequence[str], n_quantiles: int = 100):
        if n_quantiles < 2:
            raise InvalidParameter("n_quantiles from 2")
        self.columns, self.n_quantiles = list(columns), n_quantiles

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        k = min(self.n_quantiles, max(2, df.count()))
        at = [i / (k - 1) for i in range(k)]
        out = {}
        for c, q in quantiles(df, self.columns, at).items():
            x, share = value(c), F.lit(None).cast("double")
            ends: dict[float, list[float]] = {}
            for a, v in zip(at, q, strict=True):
                ends.setdefault(v, []).append(a)
            points = sorted((v, a[0], a[-1]) for v, a in ends.items())
            for (v0, _, hi0), (v1, lo1, _) in zip(points, points[1:], strict=False):
                share = F.when((x > v0) & (x < v1), F.lit(hi0) + (x - F.lit(v0)) * F.lit((lo1 - hi0) / (v1 - v0))).otherwise(share)
            for v, lo, hi in points:
                share = F.when(x == v, F.lit((lo + hi) / 2)).otherwise(share)
            out[c] = F.when(x <= points[0][0], 0.0).when(x >= points[-1][0], 1.0).otherwise(share)
        return Projection(out, self.columns)


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean, squares about it and a sum of two sets of values, of both together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, a[3] + b[3]


def _moments(batches: Iterator[pa.RecordBatch], powers: list[list[float]]) -> Iterator[pa.RecordBatch]:
    """One row a task for each column i and power j: the moments of the transformed values, and the sum of signed logs."""
    sums = {(i, j): (0, 0.0, 0.0, 0.0) for i, of in enumerate(powers) for j in range(len(of))}
    for batch in batches:
        for i, of in enumerate(powers):
            x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            u, up = np.log1p(np.abs(x)), x >= 0
            logs = float(np.sum(np.sign(x) * u))
            for j, p in enumerate(of):
                y = np.where(up, _expm1(u, p), -_expm1(u, 2 - p)) if not up.all() else _expm1(u, p)
                mean = float(y.mean())
                sums[i, j] = _joined(sums[i, j], (len(y), mean, float(np.sum((y - mean) ** 2)), logs))
    rows = list(zip(*[(*k, *v) for k, v in sums.items()], strict=True))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["i", "j", "n", "mean", "m2", "logs"])


def _expm1(u: np.ndarray, power: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return u if abs(power) < 1e-12 else np.expm1(power * u) / power


def _top(values: Sequence[float], best: int) -> float:
    """Where the polynomial through values at 0 to 8 is greatest, within 1 of the best of them."""
    v = np.array(values)
    p = np.polynomial.Polynomial.fit(np.arange(9), (v - v[best]) / max(np.ptp(v), 1e-300), 8)
    near = [r.real for r in p.deriv().roots() if abs(r.imag) < 1e-9 and abs(r.real - best) <= 1]
    return float(max(near, key=p, default=best))


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else ((x + 1) ** power - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -((1 - x) ** (2 - power) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


class PowerTransformer(Estimator):
    """Yeo-Johnson with the power of most likelihood, then standard scores. A step of the search is one aggregate over all columns.

    Nine powers at even distances narrow the span fourfold; at half a unit and less, the polynomial through their likelihoods is
    smooth enough to give the place of its maximum.
    """

    def __init__(self, columns: Sequence[str], standardize: bool = True):
        self.columns, self.standardize = list(columns), standardize

    def _likelihoods(self, df: DataFrame, powers: dict[str, list[float]]) -> dict[str, list[float]]:
        given = [powers[c] for c in self.columns]
        found = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns)]).mapInArrow(lambda batches: _moments(batches, given), "i int, j int, n long, mean double, m2 double, logs double").collect()
        out = {}
        for i, c in enumerate(self.columns):
            out[c] = []
            for j, p in enumerate(powers[c]):
                n, mean, m2, logs = 0, 0.0, 0.0, 0.0
                for r in sorted((r for r in found if (r["i"], r["j"]) == (i, j)), key=lambda r: (r["n"], r["mean"], r["m2"])):
                    n, mean, m2, logs = _joined((n, mean, m2, logs), (r["n"], r["mean"], r["m2"], r["logs"]))
                out[c].append(-n / 2 * math.log(max(m2 / max(n, 1), 1e-300)) + (p - 1) * logs)
        return out

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        span = {c: (-3.0, 5.0) for c in self.columns}
        while (wide := max(b - a for a, b in span.values())) > 1e-7:
            points = {c: [a + (b - a) * k / 8 for k in range(9)] for c, (a, b) in span.items()}
            found = self._likelihoods(df, points)
            for c in self.columns:
                best = max(range(9), key=found[c].__getitem__)
                span[c] = (points[c][max(0, best - 1)], points[c][min(8, best + 1)])
                if wide <= 0.5 and 0 < best < 8:
                    top = points[c][0] + (points[c][8] - points[c][0]) * _top(found[c], best) / 8
                    span[c] = (top - wide / 8, top + wide / 8) if wide > 0.2 else (top, top)
        self.powers = {c: (a + b) / 2 for c, (a, b) in span.items()}
        made = {c: yeo_johnson(value(c), p) for c, p in self.powers.items()}
        if not self.standardize:
            return Projection(made, self.columns)
        row = df.agg(*[x for i, c in enumerate(self.columns) for x in (F.avg(made[c]).alias(f"m{i}"), F.stddev_pop(made[c]).alias(f"s{i}"))]).first()
        return Projection({c: (made[c] - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(self.columns)}, self.columns)
