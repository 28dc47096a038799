"""Seeded tables of samples, made where they are used: every row comes from its number alone.

Columns are x0, x1, ... and y (or t). The streams of random numbers are Spark's.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def _unit(seed: int, j: int):
    """A number in [0, 1) that depends on the row's id, the seed and j alone, however rows are dealt."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(j)), F.lit(2**52)) / F.lit(float(2**52))


def _normal(seed: int, j: int):
    return F.sqrt(-2 * F.ln(1 - _unit(seed, 2 * j + 1000))) * F.cos(2 * math.pi * _unit(seed, 2 * j + 1001))


def make_blobs(spark: SparkSession, n_samples: int = 100, n_features: int = 2, centers: int = 3, cluster_std: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal clouds around centres in [-10, 10]; y is the id mod the number of centres."""
    at = np.random.default_rng(seed).uniform(-10, 10, (centers, n_features))
    y = F.pmod("id", F.lit(centers)).cast("int")
    x = [(F.element_at(F.lit(at[:, j].tolist()), y + 1) + cluster_std * _normal(seed, j)).alias(f"x{j}") for j in range(n_features)]
    return _rows(spark, n_samples).select("id", *x, y.alias("y"))


def make_classification(spark: SparkSession, n_samples: int = 100, n_features: int = 4, n_classes: int = 2, seed: int = 0) -> DataFrame:
    """Classes around corners of a cube in the first half of the columns; the others are noise."""
    useful = max(1, n_features // 2)
    corner = [[1.5 if (c >> (j % max(1, math.ceil(math.log2(n_classes))))) & 1 else -1.5 for c in range(n_classes)] for j in range(useful)]
    y = F.pmod("id", F.lit(n_classes)).cast("int")
    x = [((F.element_at(F.lit(corner[j]), y + 1) if j < useful else F.lit(0.0)) + _normal(seed, j)).alias(f"x{j}") for j in range(n_features)]
    return _rows(spark, n_samples).select("id", *x, y.alias("y"))


def make_regression(spark: SparkSession, n_samples: int = 100, n_features: int = 4, n_informative: int = 2, noise: float = 0.0, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Normal columns and a linear target; also the coefficients."""
    w = np.zeros(n_features)
    w[:n_informative] = np.random.default_rng(seed).uniform(0, 100, n_informative)
    rows = _rows(spark, n_samples).select("id", *[_normal(seed, j).alias(f"x{j}") for j in range(n_features)])
    y = sum((F.col(f"x{j}") * F.lit(float(w[j])) for j in range(n_features)), noise * _normal(seed, n_features))
    return rows.withColumn("y", y), w.tolist()


def _halves(spark: SparkSession, n: int):
    first = n // 2
    i = F.col("id")
    y = (i >= first).cast("int")
    return y, F.when(y == 0, i / max(first - 1, 1)).otherwise((i - first) / max(n - first - 1, 1))


def make_moons(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    y, t = _halves(spark, n_samples)
    a = t * math.pi
    x0 = F.when(y == 0, F.cos(a)).otherwise(1 - F.cos(a)) + noise * _normal(seed, 0)
    x1 = F.when(y == 0, F.sin(a)).otherwise(0.5 - F.sin(a)) + noise * _normal(seed, 1)
    return _rows(spark, n_samples).select("id", x0.alias("x0"), x1.alias("x1"), y.alias("y"))


def make_circles(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, factor: float = 0.8, seed: int = 0) -> DataFrame:
    first = n_samples // 2
    y = (F.col("id") >= first).cast("int")
    a = F.when(y == 0, F.col("id") / max(first, 1)).otherwise((F.col("id") - first) / max(n_samples - first, 1)) * 2 * math.pi
    r = F.when(y == 0, 1.0).otherwise(factor)
    return _rows(spark, n_samples).select("id", (r * F.cos(a) + noise * _normal(seed, 0)).alias("x0"), (r * F.sin(a) + noise * _normal(seed, 1)).alias("x1"), y.alias("y"))


def make_swiss_roll(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    t = 1.5 * math.pi * (1 + 2 * _unit(seed, 0))
    return _rows(spark, n_samples).select("id", (t * F.cos(t) + noise * _normal(seed, 1)).alias("x0"), (21 * _unit(seed, 1) + noise * _normal(seed, 2)).alias("x1"), (t * F.sin(t) + noise * _normal(seed, 3)).alias("x2"), t.alias("t"))


def make_s_curve(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    t = 3 * math.pi * (_unit(seed, 0) - 0.5)
    return _rows(spark, n_samples).select("id", (F.sin(t) + noise * _normal(seed, 1)).alias("x0"), (2 * _unit(seed, 1) + noise * _normal(seed, 2)).alias("x1"), (F.signum(t) * (F.cos(t) - 1) + noise * _normal(seed, 3)).alias("x2"), t.alias("t"))


def make_friedman1(spark: SparkSession, n_samples: int = 100, n_features: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    rows = _rows(spark, n_samples).select("id", *[_unit(seed, j).alias(f"x{j}") for j in range(n_features)])
    y = 10 * F.sin(math.pi * F.col("x0") * F.col("x1")) + 20 * (F.col("x2") - 0.5) ** 2 + 10 * F.col("x3") + 5 * F.col("x4")
    return rows.withColumn("y", y + noise * _normal(seed, n_features))


def _friedman(spark: SparkSession, n: int, seed: int) -> DataFrame:
    u = [_unit(seed, j) for j in range(4)]
    return _rows(spark, n).select("id", (u[0] * 100).alias("x0"), ((40 + 520 * u[1]) * math.pi).alias("x1"), u[2].alias("x2"), (1 + 10 * u[3]).alias("x3"))


def make_friedman2(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    inner = F.col("x1") * F.col("x2") - 1 / (F.col("x1") * F.col("x3"))
    return _friedman(spark, n_samples, seed).withColumn("y", F.sqrt(F.col("x0") ** 2 + inner**2) + noise * _normal(seed, 9))


def make_friedman3(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    inner = F.col("x1") * F.col("x2") - 1 / (F.col("x1") * F.col("x3"))
    return _friedman(spark, n_samples, seed).withColumn("y", F.atan(F.try_divide(inner, F.col("x0"))) + noise * _normal(seed, 9))


def make_hastie_10_2(spark: SparkSession, n_samples: int = 100, seed: int = 0) -> DataFrame:
    rows = _rows(spark, n_samples).select("id", *[_normal(seed, j).alias(f"x{j}") for j in range(10)])
    return rows.withColumn("y", F.when(sum((F.col(f"x{j}") ** 2 for j in range(10)), F.lit(0.0)) > 9.34, 1.0).otherwise(-1.0))


def make_sparse_uncorrelated(spark: SparkSession, n_samples: int = 100, n_features: int = 10, seed: int = 0) -> DataFrame:
    rows = _rows(spark, n_samples).select("id", *[_normal(seed, j).alias(f"x{j}") for j in range(n_features)])
    return rows.withColumn("y", F.col("x0") + 2 * F.col("x1") - 2 * F.col("x2") - 1.5 * F.col("x3") + _normal(seed, n_features))


def _columns(n_features: int, expression) -> list:
    return [expression(j).alias(f"x{j}") for j in range(n_features)]


def make_gaussian_quantiles(spark: SparkSession, n_samples: int = 100, n_features: int = 2, n_classes: int = 3, seed: int = 0) -> DataFrame:
    """Normal columns; y is the ring of the squared length that the row falls in, rings of equal chance."""
    from tessera.functions.numeric import ChiSquared

    rows = _rows(spark, n_samples).select("id", *_columns(n_features, lambda j: _normal(seed, j)))
    far = sum((F.col(f"x{j}") ** 2 for j in range(n_features)), F.lit(0.0))
    law, y = ChiSquared(n_features), F.lit(0)
    for k in range(1, n_classes):
        y = F.when(far >= law.ppf(k / n_classes), k).otherwise(y)
    return rows.withColumn("y", y)


def make_multilabel_classification(spark: SparkSession, n_samples: int = 100, n_features: int = 20, n_classes: int = 5, n_labels: int = 2, length: int = 50, seed: int = 0) -> DataFrame:
    """labels (a sorted array) and word counts: each label has words of its own, a row's words are drawn from its labels'."""
    labels = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n_labels)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(n_classes)).cast("int")))
    rows = _rows(spark, n_samples).select("id", F.sort_array(labels).alias("labels"))
    word = lambda i: F.pmod(F.xxhash64(F.lit(seed + 2), F.element_at("labels", (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), i), F.size("labels")) + 1).cast("int")), F.pmod(F.xxhash64(F.lit(seed + 3), F.col("id"), i), F.lit(max(2, n_features // 4)))), F.lit(n_features))
    words = rows.withColumn("__w", F.transform(F.sequence(F.lit(1), F.lit(length)), word))
    return words.select("id", *_columns(n_features, lambda j: F.size(F.filter("__w", lambda w: w == j)).cast("double")), "labels")


def make_low_rank_matrix(spark: SparkSession, n_samples: int = 100, n_features: int = 100, rank: int = 10, tail: float = 0.5, seed: int = 0) -> DataFrame:
    """Columns of a product of normal factors whose sizes fall as a bell up to `rank`, with a long tail of share `tail`."""
    k = min(n_samples, n_features, 4 * rank)
    sizes = [(1 - tail) * math.exp(-((i / rank) ** 2)) + tail * math.exp(-0.1 * i / rank) for i in range(k)]
    right = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_features, k)))[0]
    rows = _rows(spark, n_samples).select("id", *[(_normal(seed, i) * (sizes[i] / math.sqrt(n_samples))).alias(f"__u{i}") for i in range(k)])
    return rows.select("id", *_columns(n_features, lambda j: sum((F.col(f"__u{i}") * float(right[j, i]) for i in range(k)), F.lit(0.0))))


def make_spd_matrix(n: int, seed: int = 0):
    """A symmetric positive definite matrix."""
    r = np.random.default_rng(seed)
    a = r.uniform(size=(n, n))
    u, _, v = np.linalg.svd(a.T @ a)
    return u @ (1 + np.diag(r.uniform(size=n))) @ v


def make_sparse_spd_matrix(n: int, alpha: float = 0.95, low: float = 0.1, high: float = 0.9, seed: int = 0):
    """A symmetric positive definite matrix from a Cholesky factor with a share `alpha` of zeros off its diagonal."""
    r = np.random.default_rng(seed)
    lower = np.tril(np.where(r.uniform(size=(n, n)) > alpha, -r.uniform(low, high, (n, n)), 0.0), -1) - np.eye(n)
    order = r.permutation(n)
    lower = lower[order][:, order]
    return lower @ lower.T


def make_sparse_coded_signal(spark: SparkSession, n_samples: int = 100, n_features: int = 10, n_components: int = 20, n_nonzero: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame, object]:
    """(signals, code entries (row, col, value), dictionary of unit rows): each signal is a sum of n_nonzero dictionary rows."""
    atoms = np.random.default_rng(seed).normal(size=(n_components, n_features))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    order = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_components - 1)), lambda c: F.struct(F.xxhash64(F.lit(seed), F.col("id"), c).alias("o"), c.alias("c")))), 1, n_nonzero)
    code = _rows(spark, n_samples).select("id", F.explode(order).alias("e")).select(F.col("id").alias("row"), F.col("e.c").cast("long").alias("col"))
    code = code.withColumn("value", (F.pmod(F.xxhash64(F.lit(seed + 1), "row", "col"), F.lit(2_000_001)) - 1_000_000) / 500_000.0)
    table = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(atoms)], ", ".join(["col long", *[f"x{j} double" for j in range(n_features)]]))
    signals = code.join(F.broadcast(table), "col").groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("value") * F.col(f"x{j}")).alias(f"x{j}") for j in range(n_features)])
    return signals, code, atoms


def _blocks(spark: SparkSession, shape: tuple[int, int], clusters: tuple[int, int], value, noise: float, seed: int) -> DataFrame:
    r = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(clusters[0])).cast("int")
    rows = _rows(spark, shape[0]).select("id", r.alias("row_cluster"))
    of = lambda j: zlib.crc32(f"{seed} {j}".encode()) % clusters[1]
    return rows.select("id", "row_cluster", *_columns(shape[1], lambda j: value(F.col("row_cluster"), of(j)) + _normal(seed, j) * noise))


def make_biclusters(spark: SparkSession, shape: tuple[int, int] = (100, 20), n_clusters: int = 3, noise: float = 0.0, low: float = 10.0, high: float = 100.0, seed: int = 0) -> DataFrame:
    """Rows and columns dealt to clusters; a value from low to high where both are in one cluster, else 0, plus noise."""
    step = (high - low) / max(n_clusters - 1, 1)
    return _blocks(spark, shape, (n_clusters, n_clusters), lambda r, c: F.when(r == c, low + step * c).otherwise(0.0), noise, seed)


def make_checkerboard(spark: SparkSession, shape: tuple[int, int] = (100, 20), n_clusters: tuple[int, int] = (3, 2), noise: float = 0.0, low: float = 10.0, high: float = 100.0, seed: int = 0) -> DataFrame:
    """Rows and columns dealt to clusters; each pair of clusters has a value of its own from low to high, plus noise."""
    step = (high - low) / max(n_clusters[0] * n_clusters[1] - 1, 1)
    return _blocks(spark, shape, n_clusters, lambda r, c: (r * n_clusters[1] + c) * step + low, noise, seed)
