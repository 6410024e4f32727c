"""A saved index: postings in runs by term, document frequencies, totals and a manifest as Parquet; queries read only what they ask for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import content_hash
from packwright.functions.words import inverted, opened
from packwright.operators.lexical import EPSILON, weighted
from packwright.operators.maintain import manifest_diff
from packwright.sources.shared import remove, spread

RELATIONS = ("postings", "terms", "totals", "manifest")


@dataclass(frozen=True)
class Index:
    """postings: id, path, dl, term; terms: term, df, idf; totals: n, avgdl (one row); manifest: path, sha256."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    manifest: DataFrame


def save(files: DataFrame, folder: str) -> None:
    """Write the index of files (id, path, text) below folder, in place of what is there.

    Each text is read once: hashed, and split. Postings stay in the task that made them: their files are runs that are sorted by term, one row a term, so a
    query's terms prune pages and nothing is shuffled but counts by term. The manifest is written last: a folder without one holds no index."""
    spark = files.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    remove(spark, f"{folder}/manifest")
    hashed = spread(files.select("id", "path", "text")).withColumn("sha256", F.unhex(content_hash(F.col("text"))))
    write(inverted(hashed, apart=("sha256",)), "postings")
    runs = read("postings").select("term", "n")
    write(runs.groupBy("term").agg(F.sum("n").alias("df")), "counts")
    counts = read("counts")
    n, held = (F.coalesce(F.sum(F.when(which, F.col("df"))), F.lit(0)) for which in (F.col("term").isNull(), F.col("term").isNotNull()))
    write(counts.agg(n.alias("n"), (held / F.nullif(n, F.lit(0))).alias("avgdl")), "totals")
    counted = counts.where("term is not null").crossJoin(F.broadcast(read("totals")))  # one row
    raw = counted.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    write(raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")).repartitionByRange("term").sortWithinPartitions("term"), "terms")  # one row
    kept = read("postings").where("term is null").select(F.col("held.path").alias("path"), "sha256").select(F.inline(F.arrays_zip("path", "sha256")))
    write(kept.select("path", F.lower(F.hex("sha256")).alias("sha256")), "manifest")
    remove(spark, f"{folder}/counts")


def exists(spark: SparkSession, folder: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, folder: str) -> Index:
    runs, *others = (spark.read.parquet(f"{folder}/{name}") for name in RELATIONS)
    return Index(opened(runs).select("id", "path", "dl", "term"), *others)


def changes(index: Index, files: DataFrame) -> DataFrame:
    """path, change of files (path, text) against the index."""
    return manifest_diff(index.manifest, files.select("path", content_hash(F.col("text")).alias("sha256")))


def load_fresh(files: DataFrame, folder: str) -> tuple[Index, bool]:
    """The index of files, and whether it had to be made anew: because none is there, it can't be read, or files differ from its manifest."""
    spark = files.sparkSession
    if exists(spark, folder):
        try:
            if changes(load(spark, folder), files).isEmpty():
                return load(spark, folder), False
        except Exception as broken:  # what can't be read is built again
            if "SparkContext" in str(broken):
                raise
    save(files, folder)
    return load(spark, folder), True


def bm25(index: Index, query: list[str]) -> DataFrame:
    """id, path, score for chunks with a term of the query; the terms reach both scans."""
    wanted = index.terms.where(F.col("term").isin(query)).select("term", "idf").crossJoin(F.broadcast(index.totals.select("avgdl")))  # one row
    hits = index.postings.where(F.col("term").isin(query)).join(F.broadcast(wanted), "term")  # at most one row a query term
    return hits.groupBy("id", "path").agg(F.sum(weighted(F.col("idf"), F.col("dl"), F.col("avgdl"))).alias("score"))
