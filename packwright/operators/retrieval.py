"""Retrieval as one plan: fuse, boost, penalise, scale, rules, rerank; then a pack of what fits the budget."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions import text as X
from packwright.operators import chunks, fuse, graph, maintain
from packwright.sources import sinks


@dataclass(frozen=True)
class Query:
    """What a query asks: tokens (text.query_tokens), the folders that its tokens' domain keywords name, its kind, and rules."""

    tokens: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    kind: str = "semantic-dominant"
    rules: tuple[str, ...] = ()
    test_path: str = fuse.TEST_PATH
    semantic_weight: float = 0.6
    structural_weight: float = 0.4


def boosts(files: DataFrame, query: Query) -> DataFrame:
    """path, boost, named (whether a symbol of the file is asked for). files: path, symbols (lower-cased)."""
    if not query.tokens:
        return files.select("path", F.lit(0.0).alias("boost"), F.lit(False).alias("named"))
    symbol, path, place = fuse.boost_weights(query.kind)
    share = fuse.symbol_share(F.col("symbols"), list(query.tokens))
    within = F.when(fuse.below_any(F.col("path"), list(query.folders)), 1.0).otherwise(0.0)
    total = symbol * share + path * fuse.path_share(X.path_parts(F.col("path")), list(query.tokens)) + place * within
    return files.select("path", total.alias("boost"), (share > 0).alias("named"))


def retrieve(semantic: DataFrame, structural: DataFrame, files: DataFrame, query: Query, k: int = 100, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, score of the best k files; scores may exceed 1, as rules add after scaling.

    semantic, structural: path, score. Files that neither has come in where a symbol of theirs is asked for. rerank: a change of the best k, by default none."""
    merged = fuse.merge(fuse.min_max(semantic), fuse.min_max(structural), query.semantic_weight, query.structural_weight)
    scored = merged.join(boosts(files, query), "path", "full_outer").where("score is not null or named")
    scored = scored.select("path", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))
    scored = fuse.rule_boost(fuse.min_max(fuse.test_penalty(scored, query.test_path)), list(query.rules))
    best = scored.orderBy(F.desc("score"), "path").limit(k)
    return rerank(best).orderBy(F.desc("score"), "path") if rerank else best


@dataclass(frozen=True)
class Pack:
    text: str | bytes
    files: int
    tokens: int
    saved_by_compression: int = 0
    paths: list[str] = field(default_factory=list)


def choose(ranked: DataFrame, files: DataFrame, budget: int, phase: str = "discovery", graph_files: DataFrame | None = None, compress: bool = False, seen: Column | None = None) -> DataFrame:
    """The files of a pack: path, score, tokens, content, in no order. ranked: path, score; files: path, content, tokens.

    Phase weights, files of the graph that the list lacks, the budget (over the whole texts), then compression, then marks for
    content that the session has had: within the pack, and where seen (of the column sha256) says so."""
    ranked = fuse.phase_weights(ranked, phase)
    if graph_files is not None:
        ranked = graph.augment(ranked, graph_files)
    rows = ranked.join(files.select("path", "content", "tokens"), "path").orderBy(F.desc("score"), "path").limit(100)
    chosen = fuse.budget_prefix(rows, budget).select("path", "score", "tokens", "content")
    if compress:
        chosen = chosen.drop("content").join(chunks.compress(chosen.select("path", "content", "score")), "path").select("path", "score", "tokens", "content")
    marked = maintain.dedup_marks(chosen.withColumn("_session", F.lit(0)).withColumn("_order", -F.col("score")), "_session", "path", "content", ["_order", "path"])
    if seen is not None:
        mark = F.concat(F.lit("[DEDUPLICATED: "), F.col("path"), F.lit(" — already sent in this session. Hash: "), F.left(X.content_hash(F.col("content")), F.lit(8)), F.lit("]"))
        marked = marked.withColumn("sha256", X.content_hash(F.col("content"))).withColumn("content", F.when(seen, mark).otherwise(F.col("content")))
    return marked.select("path", "score", "tokens", "content")


def query_and_pack(chosen: DataFrame, form: str, metadata: dict[str, str], languages: Iterable[str] = ()) -> Pack:
    """The pack of choose()'s rows, which the budget bounds, in one of sinks.FORMS; content with secrets is left out of it. No file at all is an error."""
    kinds = X.secrets_found(F.coalesce("content", F.lit("")))
    rows = chosen.withColumn("secrets", kinds).withColumn("content", F.when(F.size("secrets") == 0, F.col("content")))
    rows = rows.withColumn("language", X.language_of(F.col("path"))).orderBy(F.desc("score"), "path")
    held = [r.asDict(recursive=True) for r in rows.collect()]
    if not held:
        raise ValueError("no file fits the budget")
    total = sum(r["tokens"] for r in held)
    said = {"file_count": len(held), "total_tokens": total, **metadata}
    return Pack(sinks.FORMS[form](held, said), len(held), total, paths=[r["path"] for r in held])
