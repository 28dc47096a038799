"""Row assignments for validation. Every splitter takes the columns that order the rows, which must name each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.errors import InsufficientSamples, InvalidParameter
from tessera.operators.ranks import numbered
from tessera.plans.storage import stored


def k_fold(df: DataFrame, key: Sequence[str], n_splits: int = 5) -> DataFrame:
    """fold: contiguous runs of the order; the first (rows mod n_splits) folds have a row more."""
    if n_splits < 2:
        raise InvalidParameter("n_splits from 2")
    n = df.count()
    if n < n_splits:
        raise InsufficientSamples("fewer rows than folds")
    small, more = divmod(n, n_splits)
    at = F.col("__row")
    fold = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(F.floor((at - more) / max(small, 1))).cast("int")
    return numbered(df, key, "__row").withColumn("fold", fold).drop("__row")


def stratified_k_fold(df: DataFrame, key: Sequence[str], y: str, n_splits: int = 5) -> DataFrame:
    """fold: each class is spread over the folds as the sorted labels, dealt in turn, fall."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(y).count().collect())
    dealt, start = {}, 0
    for label, n in counts:
        dealt[label] = [sum(1 for x in range(start, start + n) if x % n_splits == f) if n < 10_000 else n // n_splits + ((f - start) % n_splits < n % n_splits) for f in range(n_splits)]
        start += n
    within = F.row_number().over(W.partitionBy(y).orderBy(*key)) - 1
    fold = F.lit(n_splits - 1)
    for label, sizes in dealt.items():
        ends = [sum(sizes[: f + 1]) for f in range(n_splits)]
        own = F.lit(n_splits - 1)
        for f in range(n_splits - 2, -1, -1):
            own = F.when(F.col("__at") < ends[f], f).otherwise(own)
        fold = F.when(F.col(y) == F.lit(label), own).otherwise(fold)
    return df.withColumn("__at", within).withColumn("fold", fold.cast("int")).drop("__at")


def group_k_fold(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """fold: groups from the largest (ties: larger id first), each to the lightest fold (ties: the first)."""
    sizes = sorted(((r[1], r[0]) for r in df.groupBy(group).count().collect()), reverse=True)
    if len(sizes) < n_splits:
        raise InsufficientSamples("fewer groups than folds")
    weight, place = [0] * n_splits, {}
    for n, g in sizes:
        f = weight.index(min(weight))
        weight[f] += n
        place[g] = f
    table = df.sparkSession.createDataFrame(list(place.items()), f"`{group}` {dict(df.dtypes)[group]}, fold int")
    return df.join(F.broadcast(table), group)  # the driver holds the groups anyway


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """fold: the place of the row's group among the sorted groups."""
    groups = df.select(group).distinct()
    return df.join(_few(groups.withColumn("fold", (F.dense_rank().over(W.orderBy(group)) - 1).cast("int"))), group)


def _few(groups: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of groups to be joined: broadcast if they were counted to be few, since a group's rows would meet in one task."""
    groups = stored(groups)
    return F.broadcast(groups) if groups.count() <= most else groups


def time_series_split(df: DataFrame, key: Sequence[str], n_splits: int = 5, gap: int = 0) -> DataFrame:
    """split and part (train or test) of each row and split: test blocks of rows // (n_splits + 1) at the end, all before the gap trains."""
    n = df.count()
    size = n // (n_splits + 1)
    if size < 1:
        raise InsufficientSamples("fewer rows than splits")
    splits = F.explode(F.lit(list(range(n_splits))))
    rows = numbered(df, key, "__row").withColumn("split", splits)
    start = F.lit(n - n_splits * size) + F.col("split") * size
    part = F.when((F.col("__row") >= start) & (F.col("__row") < start + size), "test").when(F.col("__row") < start - gap, "train")
    return rows.withColumn("part", part).where("part is not null").drop("__row")


def predefined_split(df: DataFrame, test_fold: str) -> DataFrame:
    """fold: the given one; -1 is never tested."""
    folds = df.where(F.col(test_fold) >= 0).select(test_fold).distinct().withColumn("fold", (F.dense_rank().over(W.orderBy(test_fold)) - 1).cast("int"))
    return df.join(_few(folds), test_fold, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def train_test_split(df: DataFrame, key: Sequence[str], test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """part: ceil(rows * test_size) rows are test, the last in an order by a seeded hash of the key."""
    import math

    n = df.count()
    tests = math.ceil(n * test_size)
    rows = df.withColumn("__hash", F.xxhash64(F.lit(seed), *key))
    return numbered(rows, ["__hash", *key], "__row").withColumn("part", F.when(F.col("__row") >= n - tests, "test").otherwise("train")).drop("__row", "__hash")


def _drawn(seed, *parts):
    """An order that SQL can repeat: md5 of the seed and the key, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts]).cast("binary"))


def _times(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.lit(list(range(n)))))


def shuffle_split(df: DataFrame, key: Sequence[str], n_splits: int = 10, test_size: float = 0.1, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """split and part of each row and split: ceil(rows * test_size) rows (of each class, if stratified, rounded) are test, drawn anew for each split."""
    import math

    if not 0 < test_size < 1:
        raise InvalidParameter("test_size between 0 and 1")
    rows = _times(df, n_splits, "split").withColumn("__o", _drawn(seed, F.col("split").cast("string"), *key))
    by = ["split", *([stratify] if stratify else [])]
    rows = numbered(rows, [*by, "__o", *key], "__row")
    starts = rows.groupBy(*by).agg(F.min("__row").alias("__start"), F.count("*").alias("__n"))
    tests = F.round(F.col("__n") * test_size) if stratify else F.ceil(F.col("__n") * F.lit(test_size))
    rows = rows.join(starts, by).withColumn("part", F.when(F.col("__row") - F.col("__start") < tests, "test").otherwise("train"))
    if not math.ceil(test_size):
        raise InvalidParameter("test_size between 0 and 1")
    return rows.drop("__o", "__row", "__start", "__n")


def stratified_shuffle_split(df: DataFrame, key: Sequence[str], y: str, n_splits: int = 10, test_size: float = 0.1, seed: int = 0) -> DataFrame:
    return shuffle_split(df, key, n_splits, test_size, seed, y)


def repeated_k_fold(df: DataFrame, key: Sequence[str], n_splits: int = 5, n_repeats: int = 10, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """repeat and fold of each row and repeat: the rows (of each class) in an order drawn for the repeat, dealt in turn."""
    rows = _times(df, n_repeats, "repeat").withColumn("__o", _drawn(seed, F.col("repeat").cast("string"), *key))
    rows = numbered(rows, ["repeat", *([stratify] if stratify else []), "__o", *key], "__row")
    starts = rows.groupBy("repeat").agg(F.min("__row").alias("__start"))
    return rows.join(starts, "repeat").withColumn("fold", F.pmod(F.col("__row") - F.col("__start"), F.lit(n_splits)).cast("int")).drop("__o", "__row", "__start")


def repeated_stratified_k_fold(df: DataFrame, key: Sequence[str], y: str, n_splits: int = 5, n_repeats: int = 10, seed: int = 0) -> DataFrame:
    return repeated_k_fold(df, key, n_splits, n_repeats, seed, y)


def leave_one_out(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """fold: each row is a test of its own."""
    return numbered(df, key, "fold")


def leave_p_out(df: DataFrame, key: str, p: int = 2) -> DataFrame:
    """A row for each set of p rows that is a test: their keys as an ascending array, tests."""
    keys = df.select(F.col(key).alias("k")).distinct()
    out = keys.select(F.array("k").alias("tests"))
    for _ in range(p - 1):
        out = out.join(keys, F.col("k") > F.element_at("tests", -1)).select(F.concat("tests", F.array("k")).alias("tests"))
    return out


def leave_p_groups_out(df: DataFrame, group: str, p: int = 2) -> DataFrame:
    """split and part of each row and split; the splits are the sets of p groups in their order."""
    sets = leave_p_out(df, group, p)
    sets = sets.withColumn("split", (F.row_number().over(W.orderBy("tests")) - 1).cast("int"))
    return df.crossJoin(F.broadcast(sets)).withColumn("part", F.when(F.array_contains("tests", F.col(group)), "test").otherwise("train")).drop("tests")


def group_shuffle_split(df: DataFrame, group: str, n_splits: int = 5, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """shuffle_split of the groups; a row goes where its group goes."""
    return df.join(_few(shuffle_split(df.select(group).distinct(), [group], n_splits, test_size, seed)), group)


def stratified_group_k_fold(df: DataFrame, y: str, group: str, n_splits: int = 5, most_groups: int = 1_000_000) -> DataFrame:
    """fold: groups from the most uneven one, each to the fold that leaves the classes' shares most even (ties: fewest rows)."""
    import numpy as np

    if df.select(group).distinct().limit(most_groups + 1).count() > most_groups:
        raise InvalidParameter(f"more than {most_groups} groups")
    counts = df.groupBy(group, y).count().collect()
    labels, groups = sorted({r[1] for r in counts}), sorted({r[0] for r in counts})
    table = np.zeros((len(groups), len(labels)))
    for g, label, n in counts:
        table[groups.index(g) if len(groups) < 50 else _at(groups, g), labels.index(label)] = n
    total, sums = table.sum(axis=0), np.zeros((n_splits, len(labels)))
    place = {}
    for g in np.argsort(-table.std(axis=1), kind="stable"):
        best = None
        for f in range(n_splits):
            sums[f] += table[g]
            worth = ((sums / total).std(axis=0).mean(), sums[f].sum())
            sums[f] -= table[g]
            if best is None or worth[0] < best[0] - 1e-15 or abs(worth[0] - best[0]) <= 1e-15 and worth[1] < best[1]:
                best = (*worth, f)
        sums[best[2]] += table[g]
        place[groups[g]] = best[2]
    spark = df.sparkSession
    return df.join(F.broadcast(spark.createDataFrame(list(place.items()), f"`{group}` {dict(df.dtypes)[group]}, fold int")), group)


def _at(ordered: list, v) -> int:
    import bisect

    return bisect.bisect_left(ordered, v)


def check_cv(cv, df: DataFrame, key: Sequence[str], y: str | None = None) -> DataFrame:
    """df with a fold: of cv folds (stratified by y if it is given), of a function of df, or as it is."""
    if cv is None:
        cv = 5
    if isinstance(cv, int):
        return stratified_k_fold(df, key, y, cv) if y else k_fold(df, key, cv)
    return cv(df) if callable(cv) else df
