"""Fusing ranked lists: each is a table of path and score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packwright.functions import fixed
from packwright.functions.text import query_tokens

TEST_PATH = "(?i)" + "|".join(fixed.TEST_PATHS)


def min_max(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores to 0..1; all 1 where they don't differ. One aggregated row is joined, so no window gathers all rows."""
    ends = scores.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    flat = F.col("_high") - F.col("_low") < 1e-9
    scaled = F.when(flat, 1.0).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return scores.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("_low", "_high")  # one row


def merge(semantic: DataFrame, structural: DataFrame, semantic_weight: float = 0.6, structural_weight: float = 0.4) -> DataFrame:
    """Weighted sum of two lists; a path that one lacks has 0 there."""
    s, p = semantic.withColumnRenamed("score", "s"), structural.withColumnRenamed("score", "p")
    both = s.join(p, "path", "full_outer")
    return both.select("path", (semantic_weight * F.coalesce("s", F.lit(0.0)) + structural_weight * F.coalesce("p", F.lit(0.0))).alias("score"))


def best_of_file(chunks: DataFrame) -> DataFrame:
    """The best score of each path's chunks; scores of -1 or less don't count."""
    return chunks.where("score > -1").groupBy("path").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, fetch: int) -> DataFrame:
    """The best `fetch` rows with their rank; ties by path. The window sees no more than `fetch` rows."""
    best = scores.orderBy(F.desc("score"), "path").limit(fetch)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def reciprocal_rank(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over lists, each cut to max(3k, 50); min-max scaled; best k."""
    fetch = max(3 * k, 50)
    parts = [ranked(x, fetch).select("path", (1.0 / (constant + F.col("rank"))).alias("part")) for x in lists]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    fused = union.groupBy("path").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "path").limit(k)
    return min_max(fused)


def symbol_share(symbols: Column, tokens: list[str]) -> Column:
    return F.size(F.array_intersect(symbols, F.array(*map(F.lit, tokens)))) / F.lit(float(len(tokens)))


def path_share(parts: Column, tokens: list[str]) -> Column:
    """Share of tokens that a path part equals, contains (from four characters), or starts like (five)."""
    hit = lambda t: F.exists(parts, lambda p: (p == t) | ((F.length(p) >= 4) & F.contains(p, F.lit(t))) | ((F.length(p) >= 5) & F.lit(len(t) >= 5) & (F.substring(p, 1, 5) == t[:5])))
    return F.least(F.lit(1.0), sum((F.when(hit(t), 1.0).otherwise(0.0) for t in tokens), F.lit(0.0)) / len(tokens))


def below_any(path: Column, folders: list[str], boundary: bool = False) -> Column:
    """Whether the path starts with one of the folders; with boundary, a slash must follow."""
    out = F.lit(False)
    for d in folders:
        out = out | path.startswith(d + "/" if boundary else d)
    return out


def keyword_matches(token: str, keyword: str) -> bool:
    """Equal, or a common start of min(5, both lengths) characters, at least four."""
    n = min(5, len(token), len(keyword))
    return token == keyword or n >= 4 and token[:n] == keyword[:n]


def test_penalty(scores: DataFrame, pattern: str = TEST_PATH, factor: float = 0.5) -> DataFrame:
    return scores.withColumn("score", F.when(F.col("path").rlike(pattern), F.col("score") * factor).otherwise(F.col("score")))


def rule_boost(scores: DataFrame, names: list[str], boost: float = 10.0) -> DataFrame:
    """Add boost where the base name is one of names or the path ends with /name."""
    path = F.col("path")
    hit = F.element_at(F.split(path, "/"), -1).isin(names)
    for n in names:
        hit = hit | path.endswith("/" + n)
    return scores.withColumn("score", F.when(hit, F.col("score") + boost).otherwise(F.col("score")))


def phase_weights(scores: DataFrame, phase: str, test_marks: Iterable[str] = fixed.TEST_MARKS, mock_marks: Iterable[str] = fixed.MOCK_MARKS) -> DataFrame:
    """In phase test, test files count double and mock files half as much again; other phases change nothing."""
    if phase != "test":
        return scores
    any_of = lambda col, marks: F.array_contains(F.transform(F.array(*map(F.lit, marks)), lambda m: F.contains(col, m)), True)
    factor = F.when(any_of(F.col("path"), test_marks), 2.0).otherwise(1.0) * F.when(any_of(F.lower("path"), mock_marks), 1.5).otherwise(1.0)
    return scores.withColumn("score", F.col("score") * factor)


def near_keyword(token: Column, keyword: Column) -> Column:
    """keyword_matches() as an expression."""
    n = F.least(F.lit(5), F.length(token), F.length(keyword))
    return (token == keyword) | ((n >= 4) & (F.left(token, n) == F.left(keyword, n)))


def query_kind(query: Column, keywords: list[str]) -> Column:
    """path-dominant where a token fits a domain keyword, else symbol for joined words or a longer name with _, else semantic-dominant."""
    tokens, known = query_tokens(query), F.array(*map(F.lit, keywords)).cast("array<string>")
    path = F.exists(tokens, lambda t: F.exists(known, lambda k: near_keyword(t, k)))
    symbol = query.rlike(fixed.JOINED_WORDS) | F.exists(tokens, lambda t: F.contains(t, F.lit("_")) & (F.length(t) > 4))
    return F.when(path, "path-dominant").when(symbol, "symbol").otherwise("semantic-dominant")


def boost_weights(kind: str) -> tuple[float, float, float]:
    """Weights of symbol, path and domain boost for a kind of query."""
    return tuple(f * b for f, b in zip(fixed.FACTORS[kind], fixed.BOOSTS, strict=True))


def budget_prefix(scores: DataFrame, budget: int, share: float = 0.8) -> DataFrame:
    """Rows path, score, tokens in order of score while their running sum fits share of the budget; it stops at the first that doesn't.

    Cut the list to its top k first: the window is over all its rows."""
    running = F.sum("tokens").over(Window.orderBy(F.desc("score"), "path").rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn("running", running).where(F.col("running") <= int(budget * share))
