"""Domain keywords: parts of paths that name folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.fixed import NOISE



def domain_keywords(files: DataFrame) -> DataFrame:
    """keyword, dir: words of three letters or more in any part of a path, with its parent folder."""
    parent = F.coalesce(F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), F.lit("."))
    words = F.split(F.lower("path"), r"[/\-_.\s]+")
    return files.select(parent.alias("dir"), F.explode(F.array_distinct(words)).alias("keyword")).where((F.length("keyword") > 2) & ~F.col("keyword").isin(*NOISE)).distinct()


def folders_of(keywords: DataFrame) -> DataFrame:
    """keyword, n_dirs, dirs (in order). keywords: keyword, dir."""
    return keywords.groupBy("keyword").agg(F.array_sort(F.collect_set("dir")).alias("dirs")).select("keyword", F.size("dirs").cast("long").alias("n_dirs"), "dirs")


def lookup(keywords: DataFrame, prefix: str) -> DataFrame:
    """keyword, dir of keywords that start with prefix; the prefix reaches the scan."""
    return keywords.where(F.col("keyword").startswith(prefix)).distinct()


def domain_map(files: DataFrame, top: int = 50) -> DataFrame:
    """keyword, file_count, weight, top_files: by keyword of the path, most files first. files: path, weight."""
    words = F.array_distinct(F.filter(F.split(F.lower("path"), r"[/\-_.\s]+"), lambda w: (F.length(w) > 2) & ~w.isin(*NOISE)))
    rows = files.select("path", "weight", F.explode(words).alias("keyword"))
    best = F.expr("slice(array_sort(collect_list(struct(-weight as w, path))), 1, 3)")
    ranked = rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("file_count"), F.round(F.sum("weight"), 6).alias("weight"))
    chosen = ranked.orderBy(F.desc("file_count"), F.desc("weight"), "keyword").limit(top)
    # the files of the chosen keywords only, and no more than the best three of each task
    tops = rows.join(F.broadcast(chosen.select("keyword")), "keyword").groupBy("keyword", F.spark_partition_id().alias("part")).agg(best.alias("few"))
    tops = tops.groupBy("keyword").agg(F.expr("slice(array_sort(flatten(collect_list(few))), 1, 3)").alias("few"))
    return chosen.join(tops, "keyword").select("keyword", "file_count", "weight", F.array_join(F.transform("few", lambda f: f["path"]), ",").alias("top_files"))
