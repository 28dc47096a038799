"""Scaling, imputation, binning, expansion and encoding of columns.

Fitting is one aggregate job (a second where categories are listed); a model is a projection, so that it joins the
stage it is used in. Category tables are held as expressions, and are meant for columns of bounded cardinality.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Model, Projection, moments, need, quantiles, value

_EPS = 2.0**-52


class StandardScaler(Estimator):
    """(x - mean) / population standard deviation; a column that is constant up to rounding keeps scale 1."""

    def __init__(self, columns: Sequence[str], with_mean: bool = True, with_std: bool = True):
        self.columns, self.with_mean, self.with_std = list(columns), with_mean, with_std

    def fit(self, df: DataFrame) -> Projection:
        out = {}
        for c, m in moments(df, self.columns).items():
            mean, var, n = m["mean"] or 0.0, m["var"] or 0.0, m["n"]
            constant = var <= n * _EPS * var + (n * mean * _EPS) ** 2
            scale = 1.0 if constant else math.sqrt(var)
            x = value(c) - F.lit(mean) if self.with_mean else value(c)
            out[c] = x / F.lit(scale) if self.with_std else x
        return Projection(out, self.columns)


class MinMaxScaler(Estimator):
    """Affine map of each column to a range; a range below 10 eps counts as 1."""

    def __init__(self, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False):
        if feature_range[0] >= feature_range[1]:
            raise InvalidParameter("feature_range must rise")
        self.columns, self.range, self.clip = list(columns), feature_range, clip

    def fit(self, df: DataFrame) -> Projection:
        low, high = self.range
        out = {}
        for c, m in moments(df, self.columns).items():
            least = m["min"] or 0.0
            width = (m["max"] or 0.0) - least
            x = (value(c) - F.lit(least)) / F.lit(width if width >= 10 * _EPS else 1.0) * F.lit(high - low) + F.lit(low)
            out[c] = F.greatest(F.lit(low), F.least(F.lit(high), x)) if self.clip else x
        return Projection(out, self.columns)


class MaxAbsScaler(Estimator):
    """x / greatest size; a column of zeros stays."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def fit(self, df: DataFrame) -> Projection:
        return Projection({c: value(c) / F.lit(m["size"] or 1.0) for c, m in moments(df, self.columns).items()}, self.columns)


class RobustScaler(Estimator):
    """(x - median) / distance of two quantiles; a distance below 10 eps counts as 1."""

    def __init__(self, columns: Sequence[str], quantile_range: tuple[float, float] = (25.0, 75.0), with_centering: bool = True, with_scaling: bool = True):
        if not 0 <= quantile_range[0] < quantile_range[1] <= 100:
            raise InvalidParameter("quantile_range must rise within 0 and 100")
        self.columns, self.range, self.centre, self.scale = list(columns), quantile_range, with_centering, with_scaling

    def fit(self, df: DataFrame) -> Projection:
        found = quantiles(df, self.columns, [self.range[0] / 100, 0.5, self.range[1] / 100])
        out = {}
        for c, (low, middle, high) in found.items():
            width = (high or 0.0) - (low or 0.0)
            x = value(c) - F.lit(middle or 0.0) if self.centre else value(c)
            out[c] = x / F.lit(width if width >= 10 * _EPS else 1.0) if self.scale else x
        return Projection(out, self.columns)


class Normalizer(Model):
    """Rows divided by their l1, l2 or max norm; a row of zeros stays."""

    def __init__(self, columns: Sequence[str], norm: str = "l2"):
        if norm not in ("l1", "l2", "max"):
            raise InvalidParameter(f"no norm {norm}")
        self.columns, self.norm = list(columns), norm

    def transform(self, df: DataFrame) -> DataFrame:
        sizes = [F.abs(value(c)) for c in self.columns]
        if self.norm == "max":
            size = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        else:
            size = sum((s * s if self.norm == "l2" else s for s in sizes), F.lit(0.0))
            size = F.sqrt(size) if self.norm == "l2" else size
        return df.withColumns({c: value(c) / F.when(size == 0, 1.0).otherwise(size) for c in self.columns})


class Binarizer(Model):
    """1 above the threshold, else 0."""

    def __init__(self, columns: Sequence[str], threshold: float = 0.0):
        self.columns, self.threshold = list(columns), threshold

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (value(c) > self.threshold).cast("double") for c in self.columns})


class FunctionTransformer(Model):
    """Each column through a function of columns."""

    def __init__(self, columns: Sequence[str], function):
        self.columns, self.function = list(columns), function

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.function(value(c)) for c in self.columns})


def add_dummy_feature(df: DataFrame, fill: float = 1.0, name: str = "dummy") -> DataFrame:
    """A constant column in front of all others."""
    return df.select(F.lit(fill).alias(name), *df.columns)


class PolynomialFeatures(Model):
    """All products of up to `degree` columns, each as its own column named by its factors."""

    def __init__(self, columns: Sequence[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = True):
        self.columns, self.degree, self.interaction_only, self.include_bias = list(columns), degree, interaction_only, include_bias

    def terms(self) -> list[tuple[str, ...]]:
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        return [t for d in range(0 if self.include_bias else 1, self.degree + 1) for t in pick(self.columns, d)]

    def transform(self, df: DataFrame) -> DataFrame:
        columns = {}
        for term in self.terms():
            product: Column = F.lit(1.0)
            for c in term:
                product = product * value(c)
            columns["*".join(term) or "1"] = product
        return df.withColumns(columns)


class SimpleImputer(Estimator):
    """Missing values become the mean, the median, the most frequent value (the least on ties) or a constant."""

    def __init__(self, columns: Sequence[str], strategy: str = "mean", fill_value: float = 0.0):
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise InvalidParameter(f"no strategy {strategy}")
        self.columns, self.strategy, self.fill_value = list(columns), strategy, fill_value

    def fit(self, df: DataFrame) -> Model:
        need(df, self.columns)
        if self.strategy == "constant":
            fills = dict.fromkeys(self.columns, self.fill_value)
        elif self.strategy == "mean":
            fills = {c: m["mean"] for c, m in moments(df, self.columns).items()}
        elif self.strategy == "median":
            fills = {c: q[0] for c, q in quantiles(df, self.columns, [0.5]).items()}
        else:
            row = df.agg(*[F.mode(value(c), True).alias(c) for c in self.columns]).first()
            fills = {c: row[c] for c in self.columns}
        return _Imputed(fills)


class _Imputed(Model):
    def __init__(self, fills: dict[str, float | None]):
        self.fills = fills

    def transform(self, df: DataFrame) -> DataFrame:
        """A column without any value at fit goes."""
        kept = {c: F.coalesce(value(c), F.lit(float(v))) for c, v in self.fills.items() if v is not None}
        return df.withColumns(kept).drop(*[c for c, v in self.fills.items() if v is None])


class MissingIndicator(Estimator):
    """A 0/1 column c_missing for each column (or only for those with missing values at fit)."""

    def __init__(self, columns: Sequence[str], features: str = "missing-only"):
        self.columns, self.features = list(columns), features

    def fit(self, df: DataFrame) -> Projection:
        chosen = self.columns
        if self.features == "missing-only":
            found = moments(df, self.columns)
            chosen = [c for c in self.columns if found[c]["n"] < found[c]["rows"]]
        return Projection({f"{c}_missing": value(c).isNull().cast("int") for c in chosen}, self.columns)


class KBinsDiscretizer(Estimator):
    """Bin numbers by equal widths or by quantiles; a bin holds its lower edge, the last one both edges."""

    def __init__(self, columns: Sequence[str], n_bins: int = 5, strategy: str = "uniform"):
        if n_bins < 2 or strategy not in ("uniform", "quantile"):
            raise InvalidParameter("n_bins from 2, strategy uniform or quantile")
        self.columns, self.n_bins, self.strategy = list(columns), n_bins, strategy

    def fit(self, df: DataFrame) -> Projection:
        if self.strategy == "uniform":
            edges = {c: [m["min"] + (m["max"] - m["min"]) * k / self.n_bins for k in range(self.n_bins + 1)] for c, m in moments(df, self.columns).items()}
        else:
            edges = quantiles(df, self.columns, [k / self.n_bins for k in range(self.n_bins + 1)])
            edges = {c: [e for i, e in enumerate(q) if not i or e - q[i - 1] > 1e-8] for c, q in edges.items()}
        out = {}
        for c, e in edges.items():
            number: Column = F.lit(0)
            for k, edge in enumerate(e[1:-1], 1):
                number = F.when(value(c) >= edge, k).otherwise(number)
            out[c] = F.when(value(c).isNotNull(), number).cast("double")
        return Projection(out, self.columns)


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of each column, nulls left out; one job. Meant for bounded cardinality."""
    need(df, columns)
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def _index(column: str, known: list) -> Column:
    return F.array_position(F.lit(known), F.col(column)) - 1 if known else F.lit(-1)


class OrdinalEncoder(Estimator):
    """Index of the value among the sorted categories; an unknown value is an error, or `unknown_value`."""

    def __init__(self, columns: Sequence[str], unknown_value: int | None = None):
        self.columns, self.unknown_value = list(columns), unknown_value

    def fit(self, df: DataFrame) -> Projection:
        out = {}
        for c, known in categories(df, self.columns).items():
            at = _index(c, known)
            other = F.lit(self.unknown_value) if self.unknown_value is not None else F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
            out[c] = F.when(at >= 0, at).otherwise(other).cast("double")
        return Projection(out, self.columns)


class LabelEncoder(OrdinalEncoder):
    """OrdinalEncoder of one label column, with the inverse."""

    def __init__(self, column: str):
        super().__init__([column])

    def fit(self, df: DataFrame) -> Projection:
        self.classes = categories(df, self.columns)[self.columns[0]]
        return super().fit(df)

    def inverse(self, column: str) -> Column:
        return F.element_at(F.lit(self.classes), F.col(column).cast("int") + 1)


class OneHotEncoder(Estimator):
    """A 0/1 column c=value for each category; drop="first" leaves the first out; values that are unknown have none.

    Categories below min_frequency, and all but the max_categories - 1 most frequent, share the column c=infrequent.
    """

    def __init__(self, columns: Sequence[str], drop: str | None = None, min_frequency: int | None = None, max_categories: int | None = None):
        self.columns, self.drop, self.min_frequency, self.max_categories = list(columns), drop, min_frequency, max_categories

    def fit(self, df: DataFrame) -> Projection:
        need(df, self.columns)
        out = {}
        for c in self.columns:
            counts = sorted((r[0], r[1]) for r in df.where(F.col(c).isNotNull()).groupBy(c).count().collect())
            rare = {v for v, n in counts if self.min_frequency and n < self.min_frequency}
            if self.max_categories and len(counts) - len(rare) + bool(rare) > self.max_categories:
                often = sorted((x for x in enumerate(counts) if x[1][0] not in rare), key=lambda x: (-x[1][1], -x[0]))
                rare |= {v for _, (v, _) in often[self.max_categories - 1 :]}
            names = [v for v, _ in counts if v not in rare]
            columns = {f"{c}={v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int") for v in names}
            if rare:
                columns[f"{c}=infrequent"] = F.coalesce(F.col(c).isin(list(rare)), F.lit(False)).cast("int")
            out |= dict(list(columns.items())[1 if self.drop == "first" else 0 :])
        return Projection(out, self.columns)


class LabelBinarizer(OneHotEncoder):
    """OneHotEncoder of one label column."""

    def __init__(self, column: str):
        super().__init__([column])


class MultiLabelBinarizer(Estimator):
    """A 0/1 column for each label that arrays of a column hold."""

    def __init__(self, column: str):
        self.column = column

    def fit(self, df: DataFrame) -> Projection:
        labels = sorted(r[0] for r in df.select(F.explode(self.column)).distinct().collect() if r[0] is not None)
        return Projection({f"{self.column}={v}": F.coalesce(F.array_contains(self.column, v), F.lit(False)).cast("int") for v in labels}, [self.column])


class BinaryEncoder(Estimator):
    """The bits of the category's index, the highest first."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def fit(self, df: DataFrame) -> Projection:
        out = {}
        for c, known in categories(df, self.columns).items():
            bits = max(1, math.ceil(math.log2(max(len(known), 2))))
            at = _index(c, known)
            out |= {f"{c}_{b}": F.shiftright(at, bits - 1 - b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits)}
        return Projection(out, self.columns)


class TargetEncoder(Estimator):
    """Mean of the target for each category, drawn to the mean of all; unknown categories get that mean.

    smooth is a number of rows that the mean of all counts for, or "auto" for the empirical Bayes weight. The table of
    categories stays a DataFrame and is joined, so its size is not bounded.
    """

    def __init__(self, column: str, target: str, smooth: float | str = "auto", output: str | None = None):
        self.column, self.target, self.smooth, self.output = column, target, smooth, output or f"{column}_encoded"

    def fit(self, df: DataFrame) -> Model:
        y = value(self.target)
        whole = df.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
        m, v = F.lit(whole["m"]), F.lit(whole["v"])
        table = df.groupBy(self.column).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"))
        if self.smooth == "auto":
            weight = F.try_divide(v * F.col("n"), v * F.col("n") + F.col("var"))
            code = F.coalesce(weight * F.col("mean") + (1 - weight) * m, m)
        else:
            code = (F.col("n") * F.col("mean") + F.lit(float(self.smooth)) * m) / (F.col("n") + F.lit(float(self.smooth)))
        return _TargetEncoded(table.select(F.col(self.column).alias("__key"), code.alias(self.output)), self.column, self.output, whole["m"])


class _TargetEncoded(Model):
    def __init__(self, table: DataFrame, column: str, output: str, mean: float):
        self.table, self.column, self.output, self.mean = table, column, output, mean

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.table, F.col(self.column).eqNullSafe(F.col("__key")), "left")
        return joined.drop("__key").withColumn(self.output, F.coalesce(self.output, F.lit(self.mean)))


class VarianceThreshold(Estimator):
    """Drops the columns whose population variance is not above the threshold."""

    def __init__(self, columns: Sequence[str], threshold: float = 0.0):
        self.columns, self.threshold = list(columns), threshold

    def fit(self, df: DataFrame) -> Dropped:
        found = moments(df, self.columns)
        kept = [c for c in self.columns if (found[c]["var"] or 0.0) > self.threshold]
        if not kept:
            raise InvalidParameter("no column varies that much")
        return Dropped([c for c in self.columns if c not in kept])


class Dropped(Model):
    """Without some columns."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


class ColumnTransformer(Estimator):
    """Several operators side by side; what none of them takes passes through or is dropped."""

    def __init__(self, *parts: Estimator | Model, remainder: str = "drop"):
        self.parts, self.remainder = parts, remainder

    def fit(self, df: DataFrame) -> Model:
        fitted = [p.fit(df) if isinstance(p, Estimator) else p for p in self.parts]
        taken = [c for p in self.parts for c in getattr(p, "columns", [])]
        return _Columns(fitted, taken if self.remainder == "drop" else None)


class _Columns(Model):
    def __init__(self, models: Sequence[Model], only: list[str] | None):
        self.models, self.only = models, only

    def transform(self, df: DataFrame) -> DataFrame:
        before = set(df.columns)
        for m in self.models:
            df = m.transform(df)
        return df if self.only is None else df.select(*[c for c in df.columns if c in self.only or c not in before])
