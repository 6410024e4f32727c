"""Counts and latencies of an index: sums first, so that no group is held in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def counts_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), name (kind or relation), n."""
    count = lambda df, what, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return count(nodes, "node", "kind").unionByName(count(edges, "edge", "relation"))


def index_totals(files: DataFrame) -> DataFrame:
    """One row: files (distinct paths), tokens, bytes. files: path, tokens, text."""
    return files.agg(F.count_distinct("path").alias("files"), F.sum("tokens").cast("long").alias("tokens"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def running_mean(rows: DataFrame, key: str, order: list[str], value: str, last: int = 1000, places: int = 2) -> DataFrame:
    """rows with mean: of the value over the last rows of the key up to each. Sums are rounded to places, so the order of adding doesn't show."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return rows.withColumn("mean", F.round(F.sum(value).over(w), places) / F.count(value).over(w))


def percentiles(rows: DataFrame, key: str, value: str, shares: Iterable[float] = (0.5, 0.95, 0.99), places: int = 2) -> DataFrame:
    """key and p50, p95, ...: of the value rounded to places, interpolated. Equal values are counted before they are gathered."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, F.round(value, places).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(*[F.round(F.percentile("_v", s, F.col("_n")), places + 2).alias(f"p{round(100 * s)}") for s in shares])
