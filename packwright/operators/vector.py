"""Exact nearest vectors: sums over arrays, then a distributed top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similarity(vectors: DataFrame, query: list[float], kind: str = "cosine") -> DataFrame:
    """id, score. vectors: id, vector. cosine, or l2: 1 - half the squared distance. Null vectors are left out; one of another length has a null score."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    v, q = F.col("vector").cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    if kind == "cosine":
        norm = sum(float(x) ** 2 for x in query) ** 0.5 + 1e-8
        score = total(F.zip_with(v, q, lambda a, b: a * b)) / ((F.sqrt(total(F.transform(v, lambda a: a * a))) + 1e-8) * norm)
    else:
        score = 1 - total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))) / 2
    return vectors.where("vector is not null").select("id", score.alias("score"))
