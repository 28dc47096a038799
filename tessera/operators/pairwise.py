"""Distances and kernels between rows that hold arrays of doubles.

Row-aligned measures are plain expressions. Measures between all rows of two tables broadcast the second one if it has at
most `most_rows` rows. A larger one is dealt into blocks of about that many rows, and every row of the first meets each block;
the nearest rows are kept per block and merged by an aggregate. Euclidean neighbours of rows with integer keys are found in
the blocks by products of matrices, which only choose what is near enough; those distances are then added up term by term.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_dot(a, b), _norm(a) * _norm(b)), F.lit(0.0))


def _nan_euclidean(a: Column, b: Column) -> Column:
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(~F.isnan(x) & ~F.isnan(y), (x - y) ** 2)), lambda d: d.isNotNull())
    return F.sqrt(F.try_divide(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) * F.size(a), F.size(both)))


def _haversine(a: Column, b: Column) -> Column:
    h = F.sin((a[0] - b[0]) / 2) ** 2 + F.cos(a[0]) * F.cos(b[0]) * F.sin((a[1] - b[1]) / 2) ** 2
    return 2 * F.asin(F.sqrt(h))


DISTANCES = {
    "euclidean": lambda a, b: F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))),
    "sqeuclidean": lambda a, b: _sum(a, b, lambda x, y: (x - y) * (x - y)),
    "manhattan": lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y)),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "cosine": lambda a, b: 1 - _cosine(a, b),
    "haversine": _haversine,
    "nan_euclidean": _nan_euclidean,
}


def kernels(gamma: float = 1.0, degree: int = 3, coef0: float = 1.0) -> dict:
    return {
        "linear": _dot,
        "polynomial": lambda a, b: (gamma * _dot(a, b) + coef0) ** degree,
        "sigmoid": lambda a, b: F.tanh(gamma * _dot(a, b) + coef0),
        "rbf": lambda a, b: F.exp(-gamma * DISTANCES["sqeuclidean"](a, b)),
        "laplacian": lambda a, b: F.exp(-gamma * DISTANCES["manhattan"](a, b)),
        "cosine": _cosine,
        "additive_chi2": lambda a, b: -_sum(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0))),
        "chi2": lambda a, b: F.exp(-gamma * _sum(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0)))),
    }


def paired(df: DataFrame, a: str, b: str, measure: str, **options) -> DataFrame:
    """The row-aligned distance or kernel of two array columns."""
    f = DISTANCES.get(measure) or kernels(**options)[measure]
    return df.withColumn(measure, f(F.col(a), F.col(b)))


def _measure(measure: str, kernel: bool, options: dict):
    return kernels(**options)[measure] if kernel else DISTANCES[measure]


#: Bytes of vectors in a block, and cells of distances that are looked at together.
BLOCK_BYTES, CELLS = 64 << 20, 1 << 21
_FOUND = "a long, b long, distance double"


def _vectorised(left: DataFrame, right: DataFrame, key: str, measure: str) -> bool:
    """If all pairs can be met by `_in_blocks`: integers as keys, a Euclidean distance."""
    return measure in ("euclidean", "sqeuclidean") and all(dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") for df in (left, right))


def _in_blocks(left: DataFrame, right: DataFrame, key: str, vector: str, most_rows: int, choose: Callable) -> DataFrame:
    """a, b and squared distance (null beside a null) of the pairs that `choose` takes from the squared distances of two blocks."""
    if most_rows < 1:
        raise InvalidParameter("most_rows must be at least 1")
    sides = [df.select(F.col(key).cast("long").alias(k), F.col(vector).cast("array<double>").alias(v)) for df, k, v in ((left, "a", "va"), (right, "b", "vb"))]
    (n, wide), (m, wider) = [df.agg(F.count("*"), F.max(F.size(v))).first() for df, v in zip(sides, ("va", "vb"), strict=True)]
    rows = max(1, min(most_rows, BLOCK_BYTES // (8 * max(wide or 1, wider or 1, 1))))
    parts, blocks = max(1, -(-n // rows)), max(1, -(-m // rows))
    first = sides[0].withColumns({"part": F.pmod(F.xxhash64("a", "va"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    second = sides[1].withColumns({"block": F.pmod(F.xxhash64("b", "vb"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        found = _near(*_matrix(x, "a", "va"), *_matrix(y, "b", "vb"), choose)
        return pa.table([pa.array(c, t, from_pandas=False, mask=g) for c, t, g in zip(found[:3], (pa.int64(), pa.int64(), pa.float64()), (found[3], None, found[4]), strict=True)], names=["a", "b", "distance"])

    # as many partitions as pairs of blocks, so that they are not put together because they are small
    by = lambda df: df.repartition(max(1, min(parts * blocks, 10_000)), "block", "part").groupBy("block", "part")
    return by(first).cogroup(by(second)).applyInArrow(met, _FOUND)


def _matrix(rows: pa.Table, key: str, vector: str) -> tuple[np.ndarray, list, np.ndarray]:
    """Keys, in their order, with null keys first, and the vectors (None for null or with a null in it)."""
    keys, vectors = rows.column(key).to_pylist(), rows.column(vector).combine_chunks()
    flat, ends = np.asarray(vectors.values.to_numpy(zero_copy_only=False), float), vectors.offsets.to_numpy()
    missing = vectors.values.is_null().to_numpy(zero_copy_only=False) if vectors.values.null_count else None
    null = vectors.is_null().to_numpy(zero_copy_only=False)
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0))
    whole = lambda i: not null[i] and (missing is None or not missing[ends[i] : ends[i + 1]].any())
    return np.array([keys[i] is None for i in order], bool), [keys[i] or 0 for i in order], [flat[ends[i] : ends[i + 1]] if whole(i) else None for i in order]


def _near(no_a, a, va, no_b, b, vb, choose) -> tuple:
    """a, b, squared distance, and where a and the distance are null, of the pairs that are chosen."""
    a, b, out = np.array(a, np.int64), np.array(b, np.int64), []
    if not len(a) or not len(b):
        empty = np.array([], np.int64)
        return empty, empty, np.array([], float), np.array([], bool), np.array([], bool)
    size = max(len(v) if v is not None else 0 for v in [*va, *vb])
    lengths = [np.array([-1 if v is None else len(v) for v in vs]) for vs in (va, vb)]
    x, y = (np.array([np.zeros(size) if v is None else np.pad(v, (0, size - len(v))) for v in vs]).reshape(len(vs), size) for vs in (va, vb))
    yy, step = np.einsum("ij,ij->i", y, y), max(1, CELLS // len(b))
    for s in range(0, len(a), step):
        part = x[s : s + step]
        xx = np.einsum("ij,ij->i", part, part)
        with np.errstate(all="ignore"):
            rough = xx[:, None] + yy - 2 * (part @ y.T)
            slack = 1e-12 * (size + 4) * (xx[:, None] + yy)  # far more than a product of matrices rounds off
        bad = (lengths[0][s : s + step, None] != lengths[1]) | (lengths[1] < 0)

        def exact(i, j, part=part, bad=bad):
            d = np.zeros(len(i))
            for k in range(size):
                d += (part[i, k] - y[j, k]) ** 2
            return np.where(bad[i, j], np.nan, d), bad[i, j]

        i, j, d, null = choose(rough, slack, bad, exact, a[s : s + step], b)
        out.append((a[s + i], b[j], d, no_a[s + i], null))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _chosen_nearest(k: int, others_only: bool) -> Callable:
    """The k least by distance, then b; NaN is behind all numbers and null behind that."""

    def choose(rough, slack, bad, exact, a, b):
        high, low = rough + slack, rough - slack
        unsure = ~np.isfinite(rough)
        same = (a[:, None] == b) if others_only else None
        high[bad | unsure] = low[bad] = np.inf
        low[unsure & ~bad] = -np.inf
        if same is not None:
            high[same] = np.inf
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if k <= high.shape[1] else np.full(len(a), np.inf)
        take = low <= bound[:, None]
        if same is not None:
            take &= ~same
        i, j = np.nonzero(take)
        d, null = exact(i, j)
        order = np.lexsort((j, d, null, i))
        i, j, d, null = i[order], j[order], d[order], null[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        return i[keep], j[keep], d[keep], null[keep]

    return choose


def within(left: DataFrame, right: DataFrame, key: str, vector: str, radius: float, measure: str = "euclidean", most_rows: int = 10_000) -> DataFrame:
    """a, b and distance of all pairs within the radius."""
    if not _vectorised(left, right, key, measure):
        found = pairwise(left, right, key, vector, measure, most_rows=most_rows).withColumnRenamed(measure, "distance")
        return found.where(F.col("distance") <= radius)
    most = radius * radius if measure == "euclidean" else radius

    def choose(rough, slack, bad, exact, a, b):
        i, j = np.nonzero(~bad & ~(rough - slack > most * (1 + 1e-12)))
        d, null = exact(i, j)
        keep = (np.sqrt(d) if measure == "euclidean" else d) <= radius
        return i[keep], j[keep], d[keep], null[keep]

    found = _in_blocks(left, right, key, vector, most_rows, choose)
    return found.withColumn("distance", F.sqrt("distance")) if measure == "euclidean" else found


def _met(left: DataFrame, right: DataFrame, key: str, vector: str, most_rows: int) -> DataFrame:
    """a, va, b, vb and block of every row of left with every row of right, which is broadcast or dealt into blocks."""
    if most_rows < 1:
        raise InvalidParameter("most_rows must be at least 1")
    first, second = left.select(F.col(key).alias("a"), F.col(vector).alias("va")), right.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    if right.limit(most_rows + 1).count() <= most_rows:
        return first.crossJoin(F.broadcast(second)).withColumn("block", F.lit(0))
    blocks = -(-right.count() // most_rows)
    # rows of the first table are dealt as well, so that a task holds a part of either table
    parts = max(1, -(-left.count() // most_rows))
    first = first.withColumns({"part": F.pmod(F.xxhash64("a", "va"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    second = second.withColumns({"block": F.pmod(F.xxhash64("b", "vb"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    return first.join(second, ["block", "part"]).select("a", "va", "b", "vb", "block")


def pairwise(left: DataFrame, right: DataFrame, key: str, vector: str, measure: str = "euclidean", kernel: bool = False, most_rows: int = 10_000, **options) -> DataFrame:
    """a, b and the measure of every row of left with every row of right, in blocks if right has more than `most_rows` rows."""
    f = _measure(measure, kernel, options)
    return _met(left, right, key, vector, most_rows).select("a", "b", f(F.col("va"), F.col("vb")).alias(measure))


def _least(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k least of best (arrays of distance and b) of each group."""
    return rows.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def nearest(left: DataFrame, right: DataFrame, key: str, vector: str, k: int = 1, measure: str = "euclidean", others_only: bool = False, most_rows: int = 10_000, **options) -> DataFrame:
    """The k nearest rows of right for each row of left: a, b, distance and rank; ties go to the lower b.

    right may have any number of rows; see `pairwise`.
    """
    if _vectorised(left, right, key, measure) and k > 0:
        best = F.array(F.struct(F.col("distance").isNull().alias("null"), (F.sqrt("distance") if measure == "euclidean" else F.col("distance")).alias("distance"), "b"))
        found = _in_blocks(left, right, key, vector, most_rows, _chosen_nearest(k, others_only)).select(F.col("a").cast(dict(left.dtypes)[key]).alias("a"), best.alias("best"))
        found = _least(found, ["a"], k).select("a", F.posexplode("best").alias("rank", "x"))
        return found.select("a", F.col("x.b").cast(dict(right.dtypes)[key]).alias("b"), "x.distance", "rank")
    f = _measure(measure, False, options)
    rows = _met(left, right, key, vector, most_rows)
    rows = rows.where("a <> b") if others_only else rows
    rows = rows.select("a", "block", F.array(F.struct(f(F.col("va"), F.col("vb")).alias("distance"), "b")).alias("best"))
    found = _least(_least(rows, ["a", "block"], k), ["a"], k).select("a", F.posexplode("best").alias("rank", "x"))
    return found.select("a", "x.b", "x.distance", "rank")


def kernel_centred(gram: DataFrame, value: str) -> DataFrame:
    """A long Gram matrix (a, b, value) less its row and column means, plus the mean of all."""
    centred = F.col(value) - F.avg(value).over(W.partitionBy("a")) - F.avg(value).over(W.partitionBy("b"))
    whole = gram.agg(F.avg(value).alias("all"))
    return gram.withColumn(value, centred).crossJoin(F.broadcast(whole)).select("a", "b", (F.col(value) + F.col("all")).alias(value))
