"""Keeping an index current: diffs, upserts and deletes as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, change: changed, deleted or added. Both: path, sha256."""
    s, c = stored.withColumnRenamed("sha256", "was"), current.withColumnRenamed("sha256", "now")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.col("now") != F.col("was"), "changed")
    return s.join(c, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """table with rows in place of those of equal keys; of rows with one key the last by order stays (without order, the greatest). order is no column of the table."""
    names = table.columns
    last = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *names)).alias("_last")
    new = rows.groupBy(*key).agg(last).select(*[F.col("_last")[n].alias(n) for n in names])
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def clear(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.limit(0)


def dedup_marks(rows: DataFrame, session: str, path: str, content: str, order: list[str]) -> DataFrame:
    """rows with the content that a session has had before replaced by a mark that names the path it came with."""
    held = rows.withColumn("_hash", F.sha2(F.coalesce(content, F.lit("")), 256))
    first = held.groupBy(session, "_hash").agg(F.min(F.struct(*order, F.col(path).alias("_path"))).alias("_least"))
    mark = F.concat(F.lit("[DEDUPLICATED: "), F.col("_least._path"), F.lit(" \u2014 already sent in this session. Hash: "), F.left("_hash", F.lit(8)), F.lit("]"))
    same = F.struct(*order) == F.struct(*[F.col("_least")[o] for o in order])
    return held.join(first, [session, "_hash"]).withColumn(content, F.when(same, F.col(content)).otherwise(mark)).select(rows.columns)


def delete_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes of files (file) and the edges from or to them."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    kept = edges.join(gone, edges["src"] == gone["id"], "left_anti").join(gone, F.col("dst") == gone["id"], "left_anti")
    return nodes.join(gone, "id", "left_anti").select(nodes.columns), kept


def cache_lookup(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """hashes with vector and hit from a cache of sha256 and vector."""
    return hashes.join(cache, "sha256", "left").withColumn("hit", F.col("vector").isNotNull())


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def first_seen(rows: DataFrame, session: str, content: str, order: list[str]) -> DataFrame:
    """Rows with first: whether it is the first of its content in the session. A minimum per group and a join, so a hot session splits."""
    least = rows.groupBy(session, content).agg(F.min(F.struct(*order)).alias("_least"))
    return rows.join(least, [session, content]).withColumn("first", F.struct(*order) == F.col("_least")).drop("_least")
