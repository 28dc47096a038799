"""Sparse matrices as tables of (row, col, value) with their shape; COO, CSR and CSC are orders and groupings of one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidParameter


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (row, col, value), numbers from 0; places without one are 0, repeated ones add up."""

    entries: DataFrame
    shape: tuple[int, int]

    def summed(self) -> SparseMatrix:
        """One entry for each place that isn't 0."""
        return SparseMatrix(self.entries.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0"), self.shape)

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), self.shape[::-1])

    def scale(self, by: float) -> SparseMatrix:
        return SparseMatrix(self.entries.withColumn("value", F.col("value") * by), self.shape)

    def add(self, other: SparseMatrix) -> SparseMatrix:
        if self.shape != other.shape:
            raise InvalidParameter("shapes differ")
        return SparseMatrix(self.entries.unionByName(other.entries), self.shape).summed()

    def matmul(self, other: SparseMatrix) -> SparseMatrix:
        """Entries meet by the inner number; their products are added up."""
        if self.shape[1] != other.shape[0]:
            raise InvalidParameter("inner sizes differ")
        right = other.entries.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("value").alias("w"))
        met = self.entries.join(right, F.col("col") == F.col("k")).select("row", F.col("c").alias("col"), (F.col("value") * F.col("w")).alias("value"))
        return SparseMatrix(met, (self.shape[0], other.shape[1])).summed()

    def csr(self) -> DataFrame:
        """A row for each matrix row with entries: row and an array of (col, value) by col."""
        return self.summed().entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("entries"))

    def csc(self) -> DataFrame:
        return self.summed().entries.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("entries"))

    def nnz(self) -> int:
        return self.summed().entries.count()


def coo_matrix(entries: DataFrame, shape: tuple[int, int]) -> SparseMatrix:
    return SparseMatrix(entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), shape)


def from_rows(rows: DataFrame, row: str, columns: list[str]) -> SparseMatrix:
    """The entries of columns that aren't 0 or null."""
    each = rows.select(F.col(row).cast("long").alias("row"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("col", "value"))
    n = rows.agg(F.max(row)).first()[0]
    return SparseMatrix(each.where("value <> 0").withColumn("col", F.col("col").cast("long")), (0 if n is None else int(n) + 1, len(columns)))


def diags(spark: SparkSession, values: list[float], offset: int = 0) -> SparseMatrix:
    n = len(values) + abs(offset)
    rows = [(i + max(-offset, 0), i + max(offset, 0), float(v)) for i, v in enumerate(values)]
    return SparseMatrix(spark.createDataFrame(rows, "row long, col long, value double"), (n, n))


def eye(spark: SparkSession, n: int) -> SparseMatrix:
    return SparseMatrix(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value")), (n, n))


def vstack(*parts: SparseMatrix) -> SparseMatrix:
    if len({p.shape[1] for p in parts}) != 1:
        raise InvalidParameter("numbers of columns differ")
    out, height = None, 0
    for p in parts:
        moved = p.entries.withColumn("row", F.col("row") + height)
        out = moved if out is None else out.unionByName(moved)
        height += p.shape[0]
    return SparseMatrix(out, (height, parts[0].shape[1]))


def hstack(*parts: SparseMatrix) -> SparseMatrix:
    return vstack(*[p.transpose() for p in parts]).transpose()
