"""Text files of `label index:value ...` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_svmlight(lines: DataFrame, column: str = "value") -> DataFrame:
    """y and entries (array of index and value) of every line; comments and empty lines go."""
    body = F.trim(F.regexp_replace(F.col(column), "#.*$", ""))
    parts = F.split(body, r"\s+")
    pairs = F.transform(
        F.filter(F.slice(parts, 2, 2**31 - 1), lambda p: ~p.startswith("qid:")),
        lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("index"), F.split(p, ":")[1].cast("double").alias("value")),
    )
    return lines.where(body != "").select(parts[0].cast("double").alias("y"), pairs.alias("entries"))


def load_svmlight(spark: SparkSession, paths: str | Sequence[str], zero_based: bool | None = None) -> DataFrame:
    """Rows of y and entries with indices from 0; where not said, files are 1-based unless an index 0 occurs."""
    rows = parse_svmlight(spark.read.text(paths))
    if zero_based is None:
        least = rows.agg(F.min(F.array_min(F.col("entries.index")))).first()[0]
        zero_based = least is None or least == 0
    if zero_based:
        return rows
    return rows.withColumn("entries", F.transform("entries", lambda e: F.struct((e["index"] - 1).alias("index"), e["value"].alias("value"))))


def dump_svmlight(df: DataFrame, columns: Sequence[str], y: str, path: str) -> None:
    """Writes the non-zero values of columns, indices from 0."""
    parts = [F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("double").cast("string"))) for i, c in enumerate(columns)]
    df.select(F.concat_ws(" ", F.col(y).cast("double").cast("string"), *parts).alias("value")).write.text(path)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and label of every file in the folders below path; the label is the place of the folder's name."""
    rows = spark.read.text(f"{path}/*/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("folder", F.element_at(F.split("path", "/"), -2))
    names = sorted(r[0] for r in rows.select("folder").distinct().collect())
    return rows.withColumn("label", (F.array_position(F.lit(names), F.col("folder")) - 1).cast("int"))
