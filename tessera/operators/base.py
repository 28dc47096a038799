"""Estimators learn from a DataFrame and give models, which are projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, NotFinite, ShapeMismatch
from tessera.operators.ranks import exact_quantiles


class Model:
    """A fitted operator."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Estimator:
    """An operator that is to be fitted."""

    def fit(self, df: DataFrame) -> Model:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Pipeline(Estimator):
    """Steps that are fitted one after the other, each on what the ones before have made."""

    def __init__(self, *steps):
        self.steps = steps

    def fit(self, df: DataFrame) -> PipelineModel:
        models = []
        for step in self.steps:
            model = step.fit(df) if isinstance(step, Estimator) else step
            models.append(model)
            df = model.transform(df)
        return PipelineModel(models)


class PipelineModel(Model):
    def __init__(self, models: Sequence[Model]):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        for model in self.models:
            df = model.transform(df)
        return df


class Projection(Model):
    """A model that replaces or adds columns by expressions."""

    def __init__(self, columns: dict[str, Column], needs: Sequence[str] = ()):
        self.columns, self.needs = columns, needs

    def transform(self, df: DataFrame) -> DataFrame:
        need(df, self.needs)
        return df.withColumns(self.columns)


def need(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ShapeMismatch(f"columns are missing: {missing}")


def value(column: str) -> Column:
    """The column as a double, with NaN as null: both mean that a value is missing."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Count of rows and, for each column, n, mean, population variance, least, greatest and greatest size: one aggregate job.

    Missing values are left out; an infinite one is an error.
    """
    need(df, columns)
    out = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = value(c)
        out += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = df.agg(*out).first()
    if not row["rows"]:
        raise InsufficientSamples("no rows to fit on")
    found = {}
    for i, c in enumerate(columns):
        low, high = row[f"l{i}"], row[f"h{i}"]
        if low is not None and (low == float("-inf") or high == float("inf")):
            raise NotFinite(f"{c} holds infinite values")
        found[c] = {"rows": row["rows"], "n": row[f"n{i}"], "mean": row[f"m{i}"], "var": row[f"v{i}"], "min": low, "max": high, "size": None if low is None else max(abs(low), abs(high))}
    return found


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles by linear interpolation at q * (n - 1)."""
    return dict(zip(columns, exact_quantiles(df, [value(c) for c in columns], at), strict=True))
