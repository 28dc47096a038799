"""Hashing, maps and splines as features, imputation from other columns, and selection by models."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import Estimator, Model, Projection, moments, need, quantiles, value
from tessera.operators.linear import LinearRegression
from tessera.operators.model_selection import cross_val_score
from tessera.operators.preprocess import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler
from tessera.operators.text import tokens
from tessera.plans.storage import stored

# --- functions in place of estimators ---


def binarize(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (value(c) > threshold).cast("double") for c in columns})


def maxabs_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return MaxAbsScaler(columns).fit_transform(df)


def minmax_scale(df: DataFrame, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    return MinMaxScaler(columns, feature_range).fit_transform(df)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return RobustScaler(columns).fit_transform(df)


def normalize(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    return Normalizer(columns, norm).transform(df)


def normalize_with_norms(df: DataFrame, columns: Sequence[str], norm: str = "l2", output: str = "norm") -> DataFrame:
    """normalize, and the norm of each row."""
    x = [F.abs(value(c)) for c in columns]
    size = {"l2": F.sqrt(sum((v * v for v in x), F.lit(0.0))), "l1": sum(x, F.lit(0.0)), "max": F.greatest(*x) if len(x) > 1 else x[0]}[norm]
    return normalize(df.withColumn(output, size), columns, norm)


def label_binarize(df: DataFrame, column: str, classes: Sequence) -> DataFrame:
    """A 0/1 column for each of the given classes; of two only the second one's."""
    own = classes[1:] if len(classes) == 2 else classes
    return df.withColumns({f"{column}={c}": F.coalesce((F.col(column) == F.lit(c)).cast("double"), F.lit(0.0)) for c in own})


# --- hashes and maps: long tables of (key, feature, value) ---


def hashed(term: Column, n_features: int) -> tuple[Column, Column]:
    """A term's place and sign."""
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(n_features)), F.when(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)


class HashingVectorizer(Model):
    """(key, feature, value) of a text's terms, hashed to n_features places; rows scaled to norm l2, l1 or None. Nothing is fitted."""

    def __init__(self, key: str, text: str, n_features: int = 2**20, norm: str | None = "l2", alternate_sign: bool = True, lowercase: bool = True):
        if n_features < 1:
            raise InvalidParameter("n_features from 1")
        self.key, self.text, self.n_features, self.norm, self.alternate_sign, self.lowercase = key, text, n_features, norm, alternate_sign, lowercase

    def transform(self, df: DataFrame) -> DataFrame:
        place, sign = hashed(F.col("term"), self.n_features)
        terms = df.select(self.key, F.explode(tokens(F.col(self.text), self.lowercase)).alias("term"))
        rows = terms.groupBy(self.key, place.alias("feature")).agg(F.sum(sign if self.alternate_sign else F.lit(1.0)).alias("value")).where("value <> 0")
        if self.norm is None:
            return rows
        size = rows.groupBy(self.key).agg((F.sqrt(F.sum(F.col("value") ** 2)) if self.norm == "l2" else F.sum(F.abs("value"))).alias("size"))
        return rows.join(size, self.key).select(self.key, "feature", (F.col("value") / F.col("size")).alias("value"))


class FeatureHasher(Model):
    """(key, feature, value) of a map column's entries, hashed to n_features places; a text value is one with its name."""

    def __init__(self, key: str, column: str, n_features: int = 2**20, alternate_sign: bool = True):
        self.key, self.column, self.n_features, self.alternate_sign = key, column, n_features, alternate_sign

    def transform(self, df: DataFrame) -> DataFrame:
        text = "string" in dict(df.dtypes)[self.column].split(",")[-1]
        entries = df.select(self.key, F.explode(self.column).alias("name", "v"))
        term = F.concat_ws("=", "name", "v") if text else F.col("name")
        place, sign = hashed(term, self.n_features)
        size = F.lit(1.0) if text else F.col("v").cast("double")
        return entries.groupBy(self.key, place.alias("feature")).agg(F.sum(size * sign if self.alternate_sign else size).alias("value")).where("value <> 0")


class DictVectorizer(Estimator):
    """(key, feature, value) of a map column's entries over the names met in fit: numbers as they are, texts as name=text with 1.
    The vocabulary stays a table (feature, index in order of names)."""

    def __init__(self, key: str, column: str):
        self.key, self.column = key, column

    def entries(self, df: DataFrame) -> DataFrame:
        text = "string" in dict(df.dtypes)[self.column].split(",")[-1]
        rows = df.select(self.key, F.explode(self.column).alias("name", "v"))
        feature = F.concat_ws("=", "name", "v") if text else F.col("name")
        return rows.select(self.key, feature.alias("feature"), (F.lit(1.0) if text else F.col("v").cast("double")).alias("value"))

    def fit(self, df: DataFrame) -> Model:
        from tessera.operators.ranks import numbered

        return _Mapped(self, numbered(self.entries(df).select("feature").distinct(), ["feature"], "index"))


class _Mapped(Model):
    def __init__(self, settings: DictVectorizer, vocabulary: DataFrame):
        self.settings, self.vocabulary = settings, vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        return self.settings.entries(df).join(self.vocabulary, "feature").groupBy(self.settings.key, "feature", "index").agg(F.sum("value").alias("value"))

    def inverse(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.settings.key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "value")))).alias(self.settings.column))


class TfidfTransformer(Estimator):
    """A table of counts (key, term, n) times ln((1 + rows) / (1 + df)) + 1, rows scaled to norm l2, l1 or None."""

    def __init__(self, key: str, norm: str | None = "l2", smooth_idf: bool = True):
        self.key, self.norm, self.smooth_idf = key, norm, smooth_idf

    def fit(self, counts: DataFrame) -> Model:
        n = counts.select(self.key).distinct().count()
        return _Weighted(self, counts.groupBy("term").agg(F.count("*").alias("df")), n)


class _Weighted(Model):
    def __init__(self, settings: TfidfTransformer, vocabulary: DataFrame, rows: int):
        self.settings, self.vocabulary, self.rows = settings, vocabulary, rows

    def transform(self, counts: DataFrame) -> DataFrame:
        s, n = self.settings, F.lit(float(self.rows))
        idf = F.ln((n + 1) / (F.col("df") + 1)) + 1 if s.smooth_idf else F.ln(n / F.col("df")) + 1
        rows = counts.join(self.vocabulary, "term").select(s.key, "term", (F.col("n") * idf).alias("weight"))
        if s.norm is None:
            return rows
        size = rows.groupBy(s.key).agg((F.sqrt(F.sum(F.col("weight") ** 2)) if s.norm == "l2" else F.sum(F.abs("weight"))).alias("size"))
        return rows.join(size, s.key).select(s.key, "term", (F.col("weight") / F.col("size")).alias("weight"))


class SplineTransformer(Estimator):
    """B-spline columns c_s0, c_s1 and so on for each column: n_knots of them even over its range, or at its quantiles; constant beyond."""

    def __init__(self, columns: Sequence[str], n_knots: int = 5, degree: int = 3, knots: str = "uniform"):
        if n_knots < 2 or degree < 0 or knots not in ("uniform", "quantile"):
            raise InvalidParameter("n_knots from 2, degree from 0, knots uniform or quantile")
        self.columns, self.n_knots, self.degree, self.knots = list(columns), n_knots, degree, knots

    def fit(self, df: DataFrame) -> Projection:
        shares = [k / (self.n_knots - 1) for k in range(self.n_knots)]
        if self.knots == "uniform":
            base = {c: [m["min"] + (m["max"] - m["min"]) * s for s in shares] for c, m in moments(df, self.columns).items()}
        else:
            base = quantiles(df, self.columns, shares)
        out = {}
        for c, inner in base.items():
            d = self.degree
            first, last = inner[1] - inner[0], inner[-1] - inner[-2]
            t = [inner[0] - first * (d - i) for i in range(d)] + inner + [inner[-1] + last * (i + 1) for i in range(d)]
            x = F.greatest(F.lit(float(inner[0])), F.least(F.lit(float(inner[-1])), value(c)))
            end = len(inner) + d - 2  # the last interval holds its end
            basis = [F.when((x >= t[i]) & ((x < t[i + 1]) if i < end else (x <= t[i + 1])), 1.0).otherwise(0.0) if i <= end else F.lit(0.0) for i in range(len(t) - 1)]
            for k in range(1, d + 1):
                new = []
                for i in range(len(basis) - 1):
                    left = (x - t[i]) / (t[i + k] - t[i]) * basis[i] if t[i + k] > t[i] else F.lit(0.0)
                    right = (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * basis[i + 1] if t[i + k + 1] > t[i + 1] else F.lit(0.0)
                    new.append(left + right)
                basis = new
            for i, b in enumerate(basis):
                out[f"{c}_s{i}"] = F.when(value(c).isNotNull(), b)
        return Projection(out, self.columns)


# --- imputation ---


class IterativeImputer(Estimator):
    """Missing values from a linear regression on the other columns, in turn, from means, up to max_iter rounds."""

    def __init__(self, columns: Sequence[str], max_iter: int = 5):
        self.columns, self.max_iter = list(columns), max_iter

    def fit(self, df: DataFrame) -> Model:
        means = {c: m["mean"] or 0.0 for c, m in moments(df, self.columns).items()}
        self.order = sorted(self.columns, key=lambda c: df.where(value(c).isNull()).limit(1).count())
        rounds: list[dict] = []
        now = _Imputed(self.columns, means, rounds).start(df)
        for _ in range(self.max_iter):
            models = {}
            for c in self.columns:
                rest = [o for o in self.columns if o != c]
                model = LinearRegression(rest, f"__{c}", "__p").fit(now.where(F.col(f"__{c}").isNotNull()))
                models[c] = model
                now = stored(now.withColumn(c, F.coalesce(F.col(f"__{c}"), model.expression())))  # else expressions nest
            rounds.append(models)
        return _Imputed(self.columns, means, rounds)


class _Imputed(Model):
    def __init__(self, columns: Sequence[str], means: dict, rounds: list[dict]):
        self.columns, self.means, self.rounds = columns, means, rounds

    def start(self, df: DataFrame) -> DataFrame:
        need(df, self.columns)
        kept = df.withColumns({f"__{c}": value(c) for c in self.columns})
        return kept.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(float(self.means[c]))) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        now = self.start(df)
        for models in self.rounds:
            for c, model in models.items():
                now = stored(now.withColumn(c, F.coalesce(F.col(f"__{c}"), model.expression())))
        return now.drop(*[f"__{c}" for c in self.columns])


class KNNImputer(Estimator):
    """Missing values as means of the k nearest of at most `most_rows` donor rows (in order of a hash of the key), by distance over what both have."""

    def __init__(self, columns: Sequence[str], key: Sequence[str], k: int = 5, most_rows: int = 5000, seed: int = 0):
        self.columns, self.key, self.k, self.most_rows, self.seed = list(columns), list(key), k, most_rows, seed

    def fit(self, df: DataFrame) -> Model:
        x = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.columns)], F.xxhash64(F.lit(self.seed), *self.key).alias("o"))
        rows = x.orderBy("o", *[f"x{i}" for i in range(len(self.columns))]).limit(self.most_rows).drop("o").collect()
        donors = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(-1, len(self.columns))
        return _Donated(self.columns, donors, self.k)


class _Donated(Model):
    def __init__(self, columns: Sequence[str], donors: np.ndarray, k: int):
        self.columns, self.donors, self.k = columns, donors, k

    def transform(self, df: DataFrame) -> DataFrame:
        donors, k, d = self.donors, self.k, len(self.columns)

        def fill(row: np.ndarray) -> np.ndarray:
            holes = np.flatnonzero(np.isnan(row))
            if len(holes) == 0:
                return row
            off = (donors - row) ** 2
            both = (~np.isnan(off)).sum(axis=1)
            far = np.where(both > 0, np.nansum(off, axis=1) * d / np.maximum(both, 1), np.inf)
            out = row.copy()
            for j in holes:
                able = np.flatnonzero(~np.isnan(donors[:, j]) & np.isfinite(far))
                if len(able):
                    out[j] = donors[able[np.argsort(far[able], kind="stable")[:k]], j].mean()
                elif (~np.isnan(donors[:, j])).any():
                    out[j] = np.nanmean(donors[:, j])
            return out

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series([fill(np.array([np.nan if v is None else v for v in r], float)) for r in x])

        filled = df.withColumn("__filled", run(F.array(*[value(c) for c in self.columns])))
        return filled.withColumns({c: F.when(value(c).isNull(), F.nullif(F.col("__filled")[i], F.lit(float("nan")))).otherwise(value(c)) for i, c in enumerate(self.columns)}).drop("__filled")


# --- selection by models: make(columns) gives an estimator, importances(model) a number for each column ---


def coefficients(model) -> np.ndarray:
    """Sizes of a linear model's weights or a tree model's shares of the gain."""
    return np.abs(model.coefficients) if hasattr(model, "coefficients") else np.asarray(model.feature_importances())


class SelectFromModel(Estimator):
    """Keeps the columns whose importance is at least `threshold` (a number, mean or median), at most max_features of them."""

    def __init__(self, make: Callable[[list[str]], Estimator], columns: Sequence[str], threshold: float | str = "mean", max_features: int | None = None):
        self.make, self.columns, self.threshold, self.max_features = make, list(columns), threshold, max_features

    def fit(self, df: DataFrame) -> Chosen:
        size = coefficients(self.make(self.columns).fit(df))
        least = {"mean": size.mean(), "median": np.median(size)}.get(self.threshold, self.threshold) if isinstance(self.threshold, str) else self.threshold
        order = [i for i in np.argsort(-size, kind="stable") if size[i] >= least][: self.max_features]
        return Chosen(self.columns, [c for i, c in enumerate(self.columns) if i in order])


class Chosen(Model):
    """Drops the columns that weren't chosen."""

    def __init__(self, columns: Sequence[str], chosen: Sequence[str]):
        self.columns, self.chosen = list(columns), list(chosen)

    def support(self) -> list[bool]:
        return [c in self.chosen for c in self.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.columns if c not in self.chosen])


class RFE(Estimator):
    """Fits again and again, each time without the `step` least important columns, until n_features are left."""

    def __init__(self, make: Callable[[list[str]], Estimator], columns: Sequence[str], n_features: int = 1, step: int = 1):
        self.make, self.columns, self.n_features, self.step = make, list(columns), n_features, step

    def fit(self, df: DataFrame) -> Chosen:
        left, self.ranking = list(self.columns), dict.fromkeys(self.columns, 1)
        while len(left) > self.n_features:
            size = coefficients(self.make(left).fit(df))
            gone = [left[i] for i in np.argsort(size, kind="stable")[: min(self.step, len(left) - self.n_features)]]
            left = [c for c in left if c not in gone]
            for c in self.ranking:
                self.ranking[c] += c not in left
        return Chosen(self.columns, left)


class RFECV(RFE):
    """RFE with the number of columns whose mean score over the folds is best."""

    def __init__(self, make, columns, fold: str = "fold", scoring=None):
        super().__init__(make, columns)
        self.fold, self.scoring = fold, scoring

    def fit(self, df: DataFrame) -> Chosen:
        self.scores = {}
        for k in range(1, len(self.columns) + 1):
            chosen = RFE(self.make, self.columns, k).fit(df).chosen
            self.scores[k] = float(np.mean(cross_val_score(self.make(chosen), df, self.fold, self.scoring)))
        self.n_features = max(self.scores, key=lambda k: (self.scores[k], -k))
        return super().fit(df)


class SequentialFeatureSelector(Estimator):
    """Adds (forward) or takes away (backward) the column that leaves the best mean score, until n_features are chosen."""

    def __init__(self, make: Callable[[list[str]], Estimator], columns: Sequence[str], n_features: int = 1, direction: str = "forward", fold: str = "fold", scoring=None):
        if direction not in ("forward", "backward"):
            raise InvalidParameter("direction forward or backward")
        self.make, self.columns, self.n_features, self.direction, self.fold, self.scoring = make, list(columns), n_features, direction, fold, scoring

    def fit(self, df: DataFrame) -> Chosen:
        forward = self.direction == "forward"
        now: list[str] = [] if forward else list(self.columns)
        while len(now) != self.n_features:
            tried = [[*now, c] for c in self.columns if c not in now] if forward else [[c for c in now if c != gone] for gone in now]
            scores = [float(np.mean(cross_val_score(copy.deepcopy(self.make(t)), df, self.fold, self.scoring))) for t in tried]
            now = tried[int(np.argmax(scores))]
        return Chosen(self.columns, now)


def make_column_transformer(*parts):
    from tessera.operators.preprocess import ColumnTransformer

    return ColumnTransformer(*parts)


def make_column_selector(kind: str | None = None, pattern: str | None = None) -> Callable[[DataFrame], list[str]]:
    """A function of a table: its columns of a type and whose names match a pattern."""
    import re

    return lambda df: [n for n, t in df.dtypes if (kind is None or t == kind) and (pattern is None or re.search(pattern, n))]
