"""Row numbers over a whole table without putting it in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.storage import stored

#: Sketches miss a rank by one row in so many at most; a quantile is looked for among the rows up to twice as far on either side.
ACCURACY = 10_000
#: Of so few values all are looked at.
WHOLE = 100_000


def numbered(df: DataFrame, key: Sequence[str], name: str = "row") -> DataFrame:
    """Adds the place of each row, from 0, in the order of `key`, which must name each row.

    Rows are sorted into ranges; a number within the range is added to the count of the ranges before, one number
    for each range.
    """
    ranged = stored(df.repartitionByRange(*key).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.min(F.struct(*key)).alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))
    within = F.row_number().over(W.partitionBy("__range").orderBy(*key)) - 1
    return ranged.withColumn(name, within).join(starts, "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before")


def running(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums over all rows whose key is at least a row's own; keys are distinct. Ranges are summed first, so no task sorts everything."""
    ranged = stored(rows.repartitionByRange(F.desc(key)).withColumn("__range", F.spark_partition_id()))
    parts = ranged.groupBy("__range").agg(F.max(key).alias("__first"), *[F.sum(c).alias(f"__{c}") for c in sums])
    before = W.orderBy(F.desc("__first")).rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0.0)).alias(f"__b{c}") for c in sums])
    within = W.partitionBy("__range").orderBy(F.desc(key))
    out = ranged.select("*", *[F.sum(c).over(within).alias(f"__w{c}") for c in sums]).join(F.broadcast(starts), "__range")
    return out.select(*[c for c in rows.columns if c not in sums], *[(F.col(f"__w{c}") + F.col(f"__b{c}")).alias(c) for c in sums])


def neighbours(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds before_c and after_c, the values of the rows before and after in the order of `key`, null at the ends."""
    rows = numbered(df, key, "__at")
    for name, step in (("before", 1), ("after", -1)):
        other = rows.select((F.col("__at") + step).alias("__to"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        rows = rows.join(other, F.col("__at") == F.col("__to"), "left").drop("__to")
    return rows.drop("__at")


def exact_quantiles(df: DataFrame, values: Sequence[Column], at: Sequence[float], near: tuple[float, float] | None = None, whole: int = WHOLE) -> list[list[float | None]]:
    """Exact quantiles of each expression, nulls left out, by linear interpolation at q * (n - 1); None without values.

    A sketch bounds each quantile; one pass a column then counts the rows between the bounds by value and the others by the gap
    they are in. So no task holds more than a few rows in ACCURACY. `near` bounds what is looked for first, in place of a sketch.
    """
    rows = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values)])
    names, shares = rows.columns, [float(q) for q in at]
    out = [_within(rows, x, [near], shares) if near else None for x in names]
    if all(q is not None for q in out):
        return out
    counts = rows.agg(*[F.count(x) for x in names]).first()
    out = [[None] * len(shares) if not n else q for q, n in zip(out, counts, strict=True)]
    far = 2
    while left := [x for x, q in zip(names, out, strict=True) if q is None]:
        sketched = {x: n for x, n in zip(names, counts, strict=True) if x in left and n > whole}
        ends = [s for q in shares for s in (max(0.0, q - far / ACCURACY), min(1.0, q + far / ACCURACY))]
        found = rows.agg(*[F.percentile_approx(x, ends, ACCURACY).alias(x) for x in sketched]).first() if sketched else {}
        for x in left:
            bounds = [(None, None)]
            if x in sketched:
                pairs = zip(ends[::2], found[x][::2], ends[1::2], found[x][1::2], strict=True)
                bounds = [(low if a > 0 else None, high if b < 1 else None) for a, low, b, high in pairs]
            out[names.index(x)] = _within(rows, x, bounds, shares)
        far *= 8
    return out


def _within(rows: DataFrame, x: str, bounds: Sequence[tuple[float | None, float | None]], at: Sequence[float]) -> list[float | None] | None:
    """Quantiles of a column that lie within the bounds (None is open), or None if one doesn't."""
    apart: list[list[float | None]] = []
    for low, high in sorted(bounds, key=lambda b: (b[0] is not None, b[0] or 0.0)):
        if apart and (apart[-1][1] is None or low is None or low <= apart[-1][1]):
            apart[-1][1] = None if high is None or apart[-1][1] is None else max(high, apart[-1][1])
        else:
            apart.append([low, high])
    v, gap = F.col(x), F.lit(2 * len(apart))
    for i, (low, high) in reversed(list(enumerate(apart))):
        gap = F.when(v <= high, 2 * i + 1).otherwise(gap) if high is not None else F.lit(2 * i + 1)
        gap = F.when(v < low, 2 * i).otherwise(gap) if low is not None else gap
    cells = rows.where(v.isNotNull()).select(gap.alias("cell"), v.alias("v"))
    cells = stored(cells.groupBy("cell", F.when(F.col("cell") % 2 == 1, F.col("v")).alias("v")).agg(F.count("*").alias("n")))
    totals, start, n = sorted(cells.groupBy("cell").agg(F.sum("n")).collect()), {}, 0
    for cell, m in totals:
        start[cell] = n
        n += m
    if not n:
        return [None] * len(at)
    places = [q * (n - 1) for q in at]
    wanted = {}
    for r in {r for p in places for r in (math.floor(p), math.ceil(p))}:
        cell = max((c for c, s in start.items() if s <= r), key=start.__getitem__)
        if cell % 2 == 0:
            return None
        wanted[r] = (cell, r - start[cell])
    to = F.sum("n").over(W.partitionBy("cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    hit = lambda cell, r: (F.col("cell") == cell) & (F.col("to") > r) & (F.col("to") - F.col("n") <= r)
    met = cells.where("cell % 2 = 1").withColumn("to", to).where(reduce(or_, [hit(*w) for w in wanted.values()])).collect()
    value = {r: next(m["v"] for m in met if m["cell"] == cell and m["to"] - m["n"] <= p < m["to"]) for r, (cell, p) in wanted.items()}
    out = []
    for p in places:
        low, high = value[math.floor(p)], value[math.ceil(p)]
        out.append(low if low == high or math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
