"""Neighbours of rows with an array column: classes, regressions, densities and outliers. See `pairwise` for how rows meet."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter
from tessera.operators.base import value
from tessera.operators.pairwise import nearest, pairwise, within


class NearestNeighbors:
    """Rows (key, vector) to search; k nearest or all within a radius, by any measure of `pairwise`."""

    def __init__(self, key: str, vector: str, k: int = 5, radius: float = 1.0, measure: str = "euclidean"):
        self.key, self.vector, self.k, self.radius, self.measure = key, vector, k, radius, measure

    def fit(self, df: DataFrame) -> NearestNeighbors:
        self.rows = df.select(self.key, self.vector)
        return self

    def kneighbors(self, queries: DataFrame, k: int | None = None, others_only: bool = False) -> DataFrame:
        """a, b, distance, rank (from 0); ties by b."""
        return nearest(queries, self.rows, self.key, self.vector, k or self.k, self.measure, others_only)

    def radius_neighbors(self, queries: DataFrame, radius: float | None = None, others_only: bool = False) -> DataFrame:
        """a, b, distance of all pairs within the radius."""
        found = within(queries, self.rows, self.key, self.vector, self.radius if radius is None else radius, self.measure)
        return found.where("a <> b") if others_only else found


def kneighbors_graph(df: DataFrame, key: str, vector: str, k: int = 5, mode: str = "connectivity", measure: str = "euclidean") -> DataFrame:
    """a, b, value (1, or the distance) for the k nearest other rows of each."""
    found = NearestNeighbors(key, vector, k, measure=measure).fit(df).kneighbors(df, others_only=True)
    return found.select("a", "b", (F.lit(1.0) if mode == "connectivity" else F.col("distance")).alias("value"))


def radius_neighbors_graph(df: DataFrame, key: str, vector: str, radius: float, mode: str = "connectivity", measure: str = "euclidean") -> DataFrame:
    found = NearestNeighbors(key, vector, radius=radius, measure=measure).fit(df).radius_neighbors(df, others_only=True)
    return found.select("a", "b", (F.lit(1.0) if mode == "connectivity" else F.col("distance")).alias("value"))


def sort_graph_by_row_values(graph: DataFrame) -> DataFrame:
    """Each a's neighbours as an array of (value, b), nearest first."""
    return graph.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("value", "b"))).alias("neighbors"))


KNeighborsTransformer, RadiusNeighborsTransformer = kneighbors_graph, radius_neighbors_graph


class KNeighborsClassifier:
    """The label that weighs most among the k nearest rows (ties: the first label); weights uniform or distance."""

    def __init__(self, key: str, vector: str, target: str, k: int = 5, weights: str = "uniform", measure: str = "euclidean", output: str = "prediction"):
        if weights not in ("uniform", "distance"):
            raise InvalidParameter("weights uniform or distance")
        self.key, self.vector, self.target, self.k, self.weights, self.measure, self.output = key, vector, target, k, weights, measure, output

    def fit(self, df: DataFrame) -> KNeighborsClassifier:
        self.rows = df.where(F.col(self.target).isNotNull()).select(self.key, self.vector, self.target)
        return self

    def found(self, queries: DataFrame) -> DataFrame:
        met = nearest(queries, self.rows, self.key, self.vector, self.k, self.measure)
        return met.join(self.rows.select(F.col(self.key).alias("b"), F.col(self.target).alias("y")), "b")

    def weighed(self, met: DataFrame) -> DataFrame:
        """w: 1, or 1 / distance; where a row is met at distance 0, only such rows count."""
        if self.weights == "uniform":
            return met.withColumn("w", F.lit(1.0))
        exact = met.groupBy("a").agg(F.min("distance").alias("least"))
        return met.join(exact, "a").withColumn("w", F.when(F.col("least") == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))).drop("least")

    def transform(self, queries: DataFrame) -> DataFrame:
        votes = self.weighed(self.found(queries)).groupBy("a", "y").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.round("w", 12)).alias("w"), "y")).alias("best"))
        return queries.join(best.select(F.col("a").alias(self.key), F.col("best.y").alias(self.output)), self.key, "left")


class KNeighborsRegressor(KNeighborsClassifier):
    """The weighted mean of the k nearest rows' targets."""

    def transform(self, queries):
        means = self.weighed(self.found(queries)).groupBy("a").agg((F.sum(F.col("w") * value("y")) / F.sum("w")).alias(self.output))
        return queries.join(means.withColumnRenamed("a", self.key), self.key, "left")


class _Within:
    """Neighbours within a radius in place of the k nearest; rows without any have no prediction."""

    def __init__(self, *args, radius: float = 1.0, **kwargs):
        super().__init__(*args, **kwargs)
        self.radius = radius

    def found(self, queries):
        met = NearestNeighbors(self.key, self.vector, radius=self.radius, measure=self.measure).fit(self.rows).radius_neighbors(queries)
        return met.join(self.rows.select(F.col(self.key).alias("b"), F.col(self.target).alias("y")), "b")


class RadiusNeighborsClassifier(_Within, KNeighborsClassifier):
    pass


class RadiusNeighborsRegressor(_Within, KNeighborsRegressor):
    pass


class LocalOutlierFactor:
    """lof of each row: the mean reachability density of its k nearest others over its own."""

    def __init__(self, key: str, vector: str, k: int = 20, measure: str = "euclidean"):
        self.key, self.vector, self.k, self.measure = key, vector, k, measure

    def fit_transform(self, df: DataFrame) -> DataFrame:
        met = nearest(df, df, self.key, self.vector, self.k, self.measure, others_only=True).select("a", "b", "distance")
        reach = met.groupBy("a").agg(F.max("distance").alias("reach"))
        density = met.join(reach.select(F.col("a").alias("b"), "reach"), "b").groupBy("a").agg((1 / (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("density"))
        others = met.join(density.select(F.col("a").alias("b"), F.col("density").alias("other")), "b").groupBy("a").agg(F.avg("other").alias("other"))
        return density.join(others, "a").select(F.col("a").alias(self.key), (F.col("other") / F.col("density")).alias("lof"))


class KernelDensity:
    """Log density at each query: the mean kernel of its distances to all rows, scaled to integrate to 1."""

    def __init__(self, key: str, vector: str, dimensions: int, bandwidth: float = 1.0, kernel: str = "gaussian"):
        if kernel not in ("gaussian", "tophat", "epanechnikov", "linear", "exponential", "cosine"):
            raise InvalidParameter(f"unknown kernel {kernel}")
        self.key, self.vector, self.dimensions, self.bandwidth, self.kernel = key, vector, dimensions, bandwidth, kernel

    def fit(self, df: DataFrame) -> KernelDensity:
        self.rows, self.n = df.select(self.key, self.vector), df.count()
        return self

    def scale(self) -> float:
        """One over the kernel's integral at bandwidth 1."""
        from tessera.functions.numeric import quad

        d = self.dimensions
        sphere = 2 * math.pi ** (d / 2) / math.gamma(d / 2)
        shape = {"gaussian": lambda r: math.exp(-r * r / 2), "tophat": lambda r: 1.0, "epanechnikov": lambda r: 1 - r * r, "linear": lambda r: 1 - r, "exponential": lambda r: math.exp(-r), "cosine": lambda r: math.cos(math.pi * r / 2)}[self.kernel]
        reach = 1.0 if self.kernel in ("tophat", "epanechnikov", "linear", "cosine") else 60.0 + d
        return 1 / (sphere * quad(lambda r: r ** (d - 1) * shape(r), 0, reach)[0])

    def score_samples(self, queries: DataFrame) -> DataFrame:
        u = F.col("euclidean") / self.bandwidth
        shape = {"gaussian": F.exp(-u * u / 2), "tophat": F.lit(1.0), "epanechnikov": 1 - u * u, "linear": 1 - u, "exponential": F.exp(-u), "cosine": F.cos(u * math.pi / 2)}[self.kernel]
        if self.kernel not in ("gaussian", "exponential"):
            shape = F.when(u < 1, shape).otherwise(0.0)
        front = math.log(self.scale()) - self.dimensions * math.log(self.bandwidth) - math.log(self.n)
        return pairwise(queries, self.rows, self.key, self.vector).groupBy("a").agg((F.ln(F.sum(shape)) + front).alias("log_density")).withColumnRenamed("a", self.key)


# Kernels of local regression, by u = distance / bandwidth.
LOCAL_KERNELS = {
    "gaussian": lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "tricube": lambda u: F.when(F.abs(u) <= 1, 70 / 81 * (1 - F.abs(u) ** 3) ** 3).otherwise(0.0),
    "biweight": lambda u: F.when(F.abs(u) <= 1, 15 / 16 * (1 - u * u) ** 2).otherwise(0.0),
    "triweight": lambda u: F.when(F.abs(u) <= 1, 35 / 32 * (1 - u * u) ** 3).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
    "cosine": lambda u: F.when(F.abs(u) <= 1, math.pi / 4 * F.cos(u * math.pi / 2)).otherwise(0.0),
}


def silverman_bandwidth(df: DataFrame, column: str) -> float:
    """0.9 * min(standard deviation, interquartile range / 1.34) * n ** -0.2."""
    n, sd, q = df.agg(F.count(value(column)), F.stddev_samp(value(column)), F.percentile_approx(value(column), [0.25, 0.75], 100_000)).first()
    return 0.9 * min(sd, (q[1] - q[0]) / 1.34 or sd) * n**-0.2


def scott_bandwidth(df: DataFrame, column: str, dimensions: int = 1) -> float:
    """Standard deviation * n ** (-1 / (dimensions + 4))."""
    n, sd = df.agg(F.count(value(column)), F.stddev_samp(value(column))).first()
    return sd * n ** (-1 / (dimensions + 4))


class NadarayaWatson:
    """Kernel-weighted means of a target at given points of one column: rows are added up by point in one pass, with few points."""

    order = 0

    def __init__(self, column: str, target: str, bandwidth: float | str = "silverman", kernel: str = "gaussian", output: str = "prediction"):
        if kernel not in LOCAL_KERNELS:
            raise InvalidParameter(f"unknown kernel {kernel}")
        self.column, self.target, self.bandwidth, self.kernel, self.output = column, target, bandwidth, kernel, output

    def resolved(self, df: DataFrame) -> float:
        if isinstance(self.bandwidth, str):
            return {"silverman": silverman_bandwidth, "scott": scott_bandwidth}[self.bandwidth](df, self.column)
        return float(self.bandwidth)

    def at(self, df: DataFrame, points: Sequence[float]) -> DataFrame:
        """point and prediction; null where no row has weight."""
        h = self.resolved(df)
        rows = df.select(value(self.column).alias("x"), value(self.target).alias("y")).dropna()
        rows = rows.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y"))  # equal places are one row
        met = rows.withColumn("point", F.explode(F.lit([float(p) for p in points]))).withColumn("d", F.col("x") - F.col("point"))
        w = LOCAL_KERNELS[self.kernel](F.col("d") / F.lit(h))
        sums = met.withColumn("w", w).groupBy("point").agg(
            F.sum(F.col("w") * F.col("n")).alias("s0"), F.sum(F.col("w") * F.col("n") * F.col("d")).alias("s1"), F.sum(F.col("w") * F.col("n") * F.col("d") ** 2).alias("s2"),
            F.sum(F.col("w") * F.col("y")).alias("t0"), F.sum(F.col("w") * F.col("y") * F.col("d")).alias("t1"),
        )
        flat = F.try_divide(F.col("t0"), F.col("s0"))
        if not self.order:
            return sums.select("point", flat.alias(self.output))
        line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.col("s0") * F.col("s2") - F.col("s1") ** 2)
        return sums.select("point", F.coalesce(line, flat).alias(self.output))


class LocalPolynomialRegression(NadarayaWatson):
    """A line fitted around each point in place of a mean."""

    order = 1


class CrossValidatedBandwidth:
    """The bandwidth of `candidates` with the least leave-one-out squared error of NadarayaWatson, by pairs of distinct places (bounded number)."""

    def __init__(self, candidates: Sequence[float], kernel: str = "gaussian", most_places: int = 5000):
        self.candidates, self.kernel, self.most_places = list(candidates), kernel, most_places

    def resolve(self, df: DataFrame, column: str, target: str) -> float:
        rows = df.select(value(column).alias("x"), value(target).alias("y")).dropna().groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") ** 2).alias("yy"))
        if rows.limit(self.most_places + 1).count() > self.most_places:
            raise InvalidParameter(f"more than {self.most_places} distinct places")
        met = rows.select("x", "n", "y", "yy").crossJoin(F.broadcast(rows.select(F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("y").alias("y2"))))
        errors = []
        for h in self.candidates:
            w = LOCAL_KERNELS[self.kernel]((F.col("x") - F.col("x2")) / F.lit(float(h)))
            own = float(df.sparkSession.range(1).select(LOCAL_KERNELS[self.kernel](F.lit(0.0))).first()[0])
            s = met.groupBy("x", "n", "y", "yy").agg(F.sum(w * F.col("n2")).alias("s"), F.sum(w * F.col("y2")).alias("t"))
            # each of n rows leaves itself out: its prediction is (t - own * y) / (s - own)
            a, b = F.col("t") / (F.col("s") - own), F.lit(own) / (F.col("s") - own)
            loss = F.col("yy") * (1 + b) ** 2 - 2 * a * (1 + b) * F.col("y") + F.col("n") * a**2
            errors.append(s.where(F.col("s") > own).agg(F.sum(loss)).first()[0])
        return self.candidates[min(range(len(errors)), key=lambda i: (errors[i] is None, errors[i] or 0.0))]


def resolve_bandwidth(df: DataFrame, column: str, target: str, bandwidth) -> float:
    if isinstance(bandwidth, CrossValidatedBandwidth):
        return bandwidth.resolve(df, column, target)
    return NadarayaWatson(column, target, bandwidth).resolved(df)
