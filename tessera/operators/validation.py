"""Checks of tables before they are used; each is one aggregate job at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter, NotFinite, ShapeMismatch
from tessera.operators.base import need


def assert_all_finite(df: DataFrame, columns: Sequence[str], allow_missing: bool = False) -> None:
    """Raises NotFinite if a column holds an infinite value, or a null or NaN unless they are allowed."""
    need(df, columns)
    x = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.count(F.when(F.abs(v) == float("inf"), 1)) for v in x], *[F.count(F.when(v.isNull() | F.isnan(v), 1)) for v in x]).first()
    for i, c in enumerate(columns):
        if row[i]:
            raise NotFinite(f"{c} holds infinite values")
        if row[len(x) + i] and not allow_missing:
            raise NotFinite(f"{c} holds missing values")


def check_array(df: DataFrame, columns: Sequence[str], allow_missing: bool = False, min_rows: int = 1) -> DataFrame:
    """The columns as doubles, checked."""
    assert_all_finite(df, columns, allow_missing)
    if len(df.select(*columns).take(min_rows)) < min_rows:
        raise InsufficientSamples(f"fewer than {min_rows} rows")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def column_or_1d(df: DataFrame, column: str) -> DataFrame:
    """The column alone; an array or struct is an error."""
    need(df, [column])
    if dict(df.dtypes)[column].startswith(("array", "struct", "map")):
        raise ShapeMismatch(f"{column} is not a column of single values")
    return df.select(column)


def check_consistent_length(*tables: DataFrame) -> int:
    """The number of rows that all tables have."""
    counts = {t.count() for t in tables}
    if len(counts) != 1:
        raise ShapeMismatch(f"numbers of rows differ: {sorted(counts)}")
    return counts.pop()


def check_x_y(df: DataFrame, columns: Sequence[str], target: str, min_rows: int = 1) -> DataFrame:
    """check_array of the columns, and a target without missing values."""
    column_or_1d(df, target)
    if df.where(F.col(target).isNull()).limit(1).count():
        raise NotFinite(f"{target} holds missing values")
    return check_array(df, columns, min_rows=min_rows)


class Dataset:
    """A table with the roles of its columns."""

    def __init__(self, df: DataFrame, columns: Sequence[str], target: str | None = None):
        need(df, [*columns, *([target] if target else [])])
        if len(set(columns)) != len(columns):
            raise InvalidParameter("a column is named twice")
        self.df, self.columns, self.target = df, list(columns), target

    def n_samples(self) -> int:
        return self.df.count()

    def n_features(self) -> int:
        return len(self.columns)
