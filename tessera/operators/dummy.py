"""Predictions that look at the target alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Projection, value
from tessera.operators.ranks import exact_quantiles


class DummyRegressor(Estimator):
    """The mean, median, a quantile or a constant."""

    def __init__(self, target: str, strategy: str = "mean", param: float | None = None, output: str = "prediction"):
        self.target, self.strategy, self.param, self.output = target, strategy, param, output

    def fit(self, df: DataFrame) -> Projection:
        y = value(self.target)
        if self.strategy == "constant":
            return Projection({self.output: F.lit(float(self.param))})
        if self.strategy not in ("mean", "median", "quantile"):
            raise InvalidParameter(f"no strategy {self.strategy}")
        if self.strategy == "mean":
            return Projection({self.output: F.lit(df.agg(F.avg(y)).first()[0])})
        [[q]] = exact_quantiles(df, [y], [0.5 if self.strategy == "median" else self.param])
        return Projection({self.output: F.lit(q).cast("double")})


class DummyClassifier(Estimator):
    """The most frequent class, the least on ties."""

    def __init__(self, target: str, output: str = "prediction"):
        self.target, self.output = target, output

    def fit(self, df: DataFrame) -> Projection:
        return Projection({self.output: F.lit(df.agg(F.mode(self.target, True)).first()[0])})
