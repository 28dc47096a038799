"""Covariance, principal components and k-means from aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Model, Projection, need, value
from tessera.operators.linear import gram


class EmpiricalCovariance:
    """location and covariance (population) of columns."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def shrunk(self, covariance: np.ndarray, df: DataFrame, n: float) -> np.ndarray:
        return covariance

    def fit(self, df: DataFrame) -> EmpiricalCovariance:
        n, self.location, products = gram(df, self.columns)
        self.covariance = self.shrunk(products / n, df, n)
        return self

    def mahalanobis(self, df: DataFrame, output: str = "mahalanobis") -> DataFrame:
        """Squared distance of each row from the location."""
        inverse = np.linalg.pinv(self.covariance)
        x = [value(c) - F.lit(float(m)) for c, m in zip(self.columns, self.location, strict=True)]
        terms = [F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))]
        return df.withColumn(output, sum(terms[1:], terms[0]))


class ShrunkCovariance(EmpiricalCovariance):
    """(1 - s) * covariance + s * mean variance on the diagonal."""

    def __init__(self, columns: Sequence[str], shrinkage: float = 0.1):
        super().__init__(columns)
        self.shrinkage = shrinkage

    def shrunk(self, covariance, df, n):
        mu = np.trace(covariance) / len(covariance)
        return (1 - self.shrinkage) * covariance + self.shrinkage * mu * np.eye(len(covariance))


class LedoitWolf(ShrunkCovariance):
    """ShrunkCovariance whose share minimises the expected squared error."""

    def shrunk(self, covariance, df, n):
        p = len(covariance)
        x = [value(c) - F.lit(float(m)) for c, m in zip(self.columns, self.location, strict=True)]
        squares = sum((v * v for v in x[1:]), x[0] * x[0])
        fourth = df.agg(F.sum(squares * squares)).first()[0]
        delta_ = float((covariance**2).sum())
        mu = np.trace(covariance) / p
        beta = (fourth / n - delta_) / (n * p)
        delta = (delta_ - p * mu * mu) / p
        self.shrinkage = 0.0 if delta <= 0 else min(max(beta, 0.0), delta) / delta
        return super().shrunk(covariance, df, n)


class PCA(Estimator):
    """Scores pc1, pc2, ... on the axes of most variance; each axis points to where its largest entry is positive."""

    def __init__(self, columns: Sequence[str], n_components: int = 2):
        if not 1 <= n_components <= len(columns):
            raise InvalidParameter("n_components from 1 to the number of columns")
        self.columns, self.n_components = list(columns), n_components

    def fit(self, df: DataFrame) -> Projection:
        n, mean, products = gram(df, self.columns)
        values, vectors = np.linalg.eigh(products / (n - 1))
        order = np.argsort(-values)[: self.n_components]
        axes = vectors[:, order].T
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        self.explained_variance, self.components = values[order], axes
        out = {}
        for k, axis in enumerate(axes, 1):
            terms = [(value(c) - F.lit(float(m))) * F.lit(float(a)) for c, m, a in zip(self.columns, mean, axis, strict=True)]
            out[f"pc{k}"] = sum(terms[1:], terms[0])
        return Projection(out, self.columns)


class KMeans(Estimator):
    """Lloyd's iterations from given or spread first centres; a step is one aggregate job, an empty cluster keeps its centre."""

    def __init__(self, columns: Sequence[str], n_clusters: int = 8, centres: Sequence[Sequence[float]] | None = None, max_iter: int = 100, tol: float = 1e-4, output: str = "cluster"):
        self.columns, self.n_clusters, self.centres, self.max_iter, self.tol, self.output = list(columns), n_clusters, centres, max_iter, tol, output

    def _spread(self, df: DataFrame) -> np.ndarray:
        """Farthest points in turn, each found by one aggregate; the first is the row nearest to the mean."""
        x = F.array(*[value(c) for c in self.columns])
        centres: list = []
        mean = df.agg(*[F.avg(value(c)) for c in self.columns]).first()
        for _ in range(self.n_clusters):
            against = centres or [list(mean)]
            d = [sum(((value(c) - F.lit(float(v))) ** 2 for c, v in zip(self.columns, centre, strict=True)), F.lit(0.0)) for centre in against]
            near = F.least(*d) if len(d) > 1 else d[0]
            pick = F.max_by(x, F.struct(near, x)) if centres else F.min_by(x, F.struct(near, x))
            centres.append(list(df.agg(pick).first()[0]))
        return np.array(centres)

    def fit(self, df: DataFrame) -> NearestCentre:
        need(df, self.columns)
        centres = np.array(self.centres, float) if self.centres is not None else self._spread(df)
        for _ in range(self.max_iter):
            found = NearestCentre(self.columns, centres, self.output).transform(df).groupBy(self.output).agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(self.columns)]).collect()
            new = centres.copy()
            for r in found:
                new[r[0]] = [r[f"m{i}"] for i in range(len(self.columns))]
            shift = float(np.sqrt(((new - centres) ** 2).sum(axis=1)).max())
            centres = new
            if shift < self.tol:
                break
        return NearestCentre(self.columns, centres, self.output)


class NearestCentre(Model):
    """The number of the nearest centre, the first on ties."""

    def __init__(self, columns: Sequence[str], centres: np.ndarray, output: str):
        self.columns, self.centres, self.output = list(columns), np.asarray(centres, float), output

    def transform(self, df: DataFrame) -> DataFrame:
        d = [sum(((value(c) - F.lit(float(v))) ** 2 for c, v in zip(self.columns, centre, strict=True)), F.lit(0.0)) for centre in self.centres]
        return df.withColumn(self.output, (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int"))
