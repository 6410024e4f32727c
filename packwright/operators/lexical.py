"""BM25 over chunks as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.words import inverted, opened
from packwright.sources.shared import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def weighted(idf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part of the score; terms are distinct in a chunk, so their frequency there is 1."""
    return idf * (K1 + 1) / (1 + K1 * (1 - B + B * dl / avgdl))


def bm25(chunks: DataFrame, query: list[str]) -> DataFrame:
    """id, score for chunks with a term of the query. chunks: id, text.

    A negative idf becomes EPSILON of the mean idf. Texts are split once: that pass leaves counts by term in the shared folder, and the
    rows of the query's terms; all else is made of these."""
    runs = cut(inverted(spread(chunks.select("id", "text")), query))
    df = cut(runs.groupBy("term").agg(F.sum("n").alias("df")))
    n, held = (F.sum(F.when(which, F.col("df"))) for which in (F.col("term").isNull(), F.col("term").isNotNull()))
    size = df.agg(n.alias("n"), (held / n).alias("avgdl"))
    idf = df.where("term is not null").crossJoin(F.broadcast(size)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"), "avgdl")  # size is one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    wanted = idf.where(F.col("term").isin(query)).crossJoin(F.broadcast(mean))
    wanted = wanted.select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    weight = weighted(F.col("idf"), F.col("dl"), F.col("avgdl"))
    return opened(runs).where(F.col("term").isin(query)).join(F.broadcast(wanted), "term").groupBy("id").agg(F.sum(weight).alias("score"))  # at most one row a query term


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)
