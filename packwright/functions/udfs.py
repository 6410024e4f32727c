"""What a user may plug in, as Arrow-batched functions: embedding, token counts and reranking. Models are made once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import token_estimate

_made: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """make()'s result, made when first asked for in this worker."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def hashed_features(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed feature hashing of words, rows of unit length (zero without a word)."""
    import zlib

    out = np.zeros((len(texts), dim))
    for k, text in enumerate(texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % dim] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_features, key: str = "hashed") -> Callable[[Column], Column]:
    """A column function from text to array<float>. make() gives, in a worker, a function from texts to one row of numbers each; key names what it makes."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        model = once(f"embed:{key}", make)
        return pd.Series(list(np.asarray(model([t or "" for t in text]), np.float32))) if len(text) else pd.Series([], dtype=object)

    return embed


def embedded(files: DataFrame, cache: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """files (id, text, sha256) with vector: from the cache (sha256, vector), and made where it lacks one. Each text that misses is embedded once."""
    misses = files.join(cache, "sha256", "left_anti").groupBy("sha256").agg(F.first("text").alias("text"))
    return files.join(cache.select("sha256", "vector").unionByName(misses.select("sha256", embed(F.col("text")).alias("vector"))), "sha256")


def token_counter(make: Callable[[], Callable[[str], int]] | None = None, key: str = "") -> Callable[[Column], Column]:
    """A column function from text to its number of tokens: an estimate (characters over 4) unless make() gives a tokenizer's count."""
    if make is None:
        return token_estimate

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        model = once(f"tokens:{key}", make)
        return pd.Series([model(t or "") for t in text], dtype="int64")

    return count


def reranker(query: str, texts: DataFrame, make: Callable[[], Callable[[str, list[str]], list[float]]], key: str) -> Callable[[DataFrame], DataFrame]:
    """A change of a ranked list (path, score) for retrieval.retrieve: scores of a model of query and text, scaled to 0..1. texts: path, text; without a text the score is 0."""
    from packwright.operators.fuse import min_max

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        model = once(f"rerank:{key}", make)
        return pd.Series([float(s) for s in model(query, [t or "" for t in text])] if len(text) else [], dtype="float64")

    return lambda ranked: min_max(ranked.select("path").join(texts, "path", "left").select("path", judge("text").alias("score")))
