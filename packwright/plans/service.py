"""An indexed file tree and the calls that a client makes on it, with error codes, rate limits and a short-lived cache."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import text as X
from packwright.operators import chunks, domain, fuse, graph, index, retrieval
from packwright.plans.settings import Settings, checked_limit, inside
from packwright.sources import files
from packwright.sources.shared import stamp


class ServiceError(Exception):
    """code: INVALID_ARGUMENT, INDEX_NOT_FOUND, RATE_LIMIT_EXCEEDED, GRAPH_UNAVAILABLE, TOOL_NOT_FOUND, SEARCH_FAILED or PACK_FAILED."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def source_files(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """id, path, text, language of the files below root that the settings take."""
    scan = files.walk if settings.respect_gitignore else files.scan_files
    found = files.filter_globs(scan(spark, root), [*settings.include_patterns, "**/*.md"], list(settings.exclude_patterns))
    return found.select(F.xxhash64("path").alias("id"), "path", F.col("content").alias("text"), X.language_of(F.col("path")).alias("language"))


def index_tree(spark: SparkSession, root: str, folder: str, settings: Settings = Settings()) -> bool:
    """Bring the index of root in folder up to date; whether anything was made anew."""
    found = source_files(spark, root, settings)
    _, made = index.load_fresh(found, folder)
    if made:
        code = chunks.chunk_code(found.where("language not in ('markdown', 'text', 'json')").select("path", F.col("text").alias("content"), "language"))
        code.write.mode("overwrite").parquet(f"{folder}/chunks")
        code = spark.read.parquet(f"{folder}/chunks").withColumn("seq", F.col("start_line"))
        found.select("path", F.col("text").alias("content"), X.token_estimate(F.col("text")).alias("tokens")).write.mode("overwrite").parquet(f"{folder}/contents")
        graph.nodes_of(code).write.mode("overwrite").parquet(f"{folder}/nodes")
        graph.edges_of(code).write.mode("overwrite").parquet(f"{folder}/edges")
        uses = graph.file_edges(code)
        uses.write.mode("overwrite").parquet(f"{folder}/file_edges")
        ranks = graph.pagerank(spark.read.parquet(f"{folder}/file_edges"))
        ranks.withColumnRenamed("node", "path").write.mode("overwrite").parquet(f"{folder}/ranks")
    return made


@dataclass
class Bucket:
    """Tokens that fill at rate a second up to size."""

    size: float
    rate: float
    tokens: float
    last: float

    def take(self, now: float) -> bool:
        self.tokens = min(self.size, self.tokens + max(0.0, now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class Service:
    """Calls by name over an index that index_tree() made. Answers are dicts; an error is {"error": code, "message": text}."""

    def __init__(self, spark: SparkSession, root: str, folder: str, settings: Settings = Settings(), per_minute: int = 60, ttl: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.folder, self.settings, self.ttl, self.clock = spark, root, folder, settings, ttl, clock
        self.buckets: dict[str, Bucket] = {}
        self.per_minute = per_minute
        self.cache: dict[str, tuple[float, dict]] = {}
        self.seen: dict[str, set[str]] = {}
        self.tools = {f.__name__: f for f in (
            self.search_codebase, self.pack_context, self.get_file_context, self.get_domain_map, self.get_index_status, self.get_status, self.session_clear,
            self.find_callers, self.impact_analysis, self.graph_search, self.call_chain,
        )}

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """Name, cache, rate limit, then the tool."""
        arguments = arguments or {}
        try:
            if name not in self.tools:
                raise ServiceError("TOOL_NOT_FOUND", f"no tool {name}")
            key, now = json.dumps([name, arguments], sort_keys=True, default=str), self.clock()
            kept = self.cache.get(key)
            if kept and now - kept[0] < self.ttl:
                return kept[1]
            bucket = self.buckets.setdefault(name, Bucket(self.per_minute, self.per_minute / 60, self.per_minute, now))
            if not bucket.take(now):
                raise ServiceError("RATE_LIMIT_EXCEEDED", f"more than {self.per_minute} calls of {name} a minute")
            try:
                answer = self.tools[name](**arguments)
            except TypeError as wrong:
                raise ServiceError("INVALID_ARGUMENT", str(wrong)) from wrong
            if name in ("get_domain_map", "get_index_status", "get_status"):
                self.cache[key] = (now, answer)
            return answer
        except ServiceError as e:
            return {"error": e.code, "message": str(e)}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _index(self) -> index.Index:
        if not index.exists(self.spark, self.folder):
            raise ServiceError("INDEX_NOT_FOUND", f"no index in {self.folder}")
        return index.load(self.spark, self.folder)

    def _text(self, value: object, what: str) -> str:
        if not isinstance(value, str) or not value.strip():
            raise ServiceError("INVALID_ARGUMENT", f"{what} must be text")
        return value

    def _ranked(self, query: str, k: int) -> DataFrame:
        own = self._index()
        one = self.spark.createDataFrame([(query,)], "q string")
        folders = domain.domain_keywords(self._read("contents").select("path"))
        asked = one.select(X.query_terms(F.col("q")).alias("terms"), X.query_tokens(F.col("q")).alias("tokens")).first()
        hit = F.lit(False)
        for t in asked["tokens"]:
            hit = hit | fuse.near_keyword(F.lit(t), F.col("keyword"))
        near = folders.where(hit).groupBy("dir").agg(F.first("keyword").alias("keyword")).orderBy("dir").limit(100).collect()  # folders that bear a word of the query
        kind = one.select(fuse.query_kind(F.col("q"), [r["keyword"] for r in near]).alias("kind")).first()["kind"]
        semantic = fuse.best_of_file(lexical_scores(own, asked["terms"]))
        symbols = self._read("chunks").groupBy("path").agg(F.flatten(F.collect_list("symbols_defined")).alias("s"))
        held = self._read("contents").select("path").join(symbols, "path", "left")
        held = held.select("path", F.transform(F.coalesce("s", F.array().cast("array<string>")), F.lower).alias("symbols"))
        query_ = retrieval.Query(tuple(asked["tokens"]), tuple(r["dir"] for r in near if r["dir"] != "."), kind, (), fuse.TEST_PATH, self.settings.semantic_weight, self.settings.pagerank_weight)
        return retrieval.retrieve(semantic, self._read("ranks").withColumnRenamed("rank", "score"), held, query_, k)

    def search_codebase(self, query: str, limit: int = 10, domain_filter: str | None = None) -> dict:
        query = self._text(query, "query")
        try:
            checked_limit(limit)
        except (ValueError, TypeError) as wrong:
            raise ServiceError("INVALID_ARGUMENT", str(wrong)) from wrong
        words = [r[0] for r in domain.domain_keywords(self._read("contents").select("path")).select("keyword").distinct().orderBy("keyword").limit(1000).collect()] if domain_filter else []
        found = self._ranked(query, max(5 * limit, 50)).join(self._read("contents"), "path")
        found = found.select("path", F.round("score", 4).alias("score"), X.infer_domain(F.col("path"), words or ["general"]).alias("domain"), X.summary_line(F.col("content")).alias("summary"))
        rows = [r.asDict() for r in found.orderBy(F.desc("score"), "path").collect() if domain_filter in (None, r["domain"])]  # at most 250 rows
        return {"results": rows[:limit], "index_health": self.get_index_status()}

    def pack_context(self, query: str, format: str = "xml", token_budget: int | None = None, phase: str = "discovery", compress: bool = False, session: str | None = None) -> dict:
        query = self._text(query, "query")
        if format not in ("xml", "json", "yaml", "md", "toon"):
            raise ServiceError("INVALID_ARGUMENT", f"no format {format}")
        seen = self.seen.setdefault(session, set()) if session else set()
        had = F.col("sha256").isin(*sorted(seen)) if seen else None
        chosen = retrieval.choose(self._ranked(query, 100), self._read("contents"), token_budget or self.settings.token_budget, phase, None, compress, had)
        try:
            pack = retrieval.query_and_pack(chosen, format, {"query": query})
        except ValueError as none:
            raise ServiceError("PACK_FAILED", str(none)) from none
        if session:
            seen.update(r[0] for r in self._read("contents").where(F.col("path").isin(*pack.paths)).select(X.content_hash(F.col("content"))).collect())
        return {"pack": pack.text, "files": pack.files, "total_tokens": pack.tokens}

    def get_file_context(self, path: str) -> dict:
        try:
            inside("/root", self._text(path, "path"))
        except ValueError as wrong:
            raise ServiceError("INVALID_ARGUMENT", str(wrong)) from wrong
        row = self._read("contents").where(F.col("path") == path).first()
        if row is None:
            raise ServiceError("INVALID_ARGUMENT", f"no file {path}")
        near = graph.neighbours(self._read("file_edges").where((F.col("src") == path) | (F.col("dst") == path))).where(F.col("id") == path).first()
        one = self.spark.createDataFrame([(path, row["content"])], "path string, content string")
        said = one.select(X.language_of(F.col("path")).alias("language"), X.line_count(F.col("content")).alias("lines"), X.secrets_found(F.col("content")).alias("secrets")).first()
        hidden = bool(said["secrets"])
        return {"path": path, "language": said["language"], "lines": said["lines"], "content": None if hidden else row["content"], "secrets_detected": list(said["secrets"]), "dependencies": list(near["successors"]) if near else [], "dependents": list(near["predecessors"]) if near else []}

    def get_domain_map(self) -> dict:
        self._index()
        weights = self._read("contents").select("path").join(self._read("ranks"), "path", "left").select("path", F.coalesce("rank", F.lit(0.0)).alias("weight"))
        stats = self._read("file_edges").agg(F.count(F.lit(1)).alias("m")).first()["m"]
        return {"domains": [r.asDict() for r in domain.domain_map(weights).collect()], "edges": stats}

    def get_index_status(self) -> dict:
        own = self._index()
        gone = index.changes(own, source_files(self.spark, self.root, self.settings)).groupBy("change").count().collect()
        return {"status": "stale" if gone else "current", "files_indexed": own.manifest.count(), "changes": {r["change"]: r["count"] for r in gone}}

    def get_status(self) -> dict:
        size = sum(int(line.split()[-2]) for line in stamp(self.spark, self.folder).splitlines()) if index.exists(self.spark, self.folder) else 0
        said = self.spark.createDataFrame([(size,)], "n long").select(X.byte_text(F.col("n"))).first()[0]
        return {"indexed": size > 0, "size": said, "calls_left": {k: int(b.tokens) for k, b in self.buckets.items()}}

    def session_clear(self, session: str | None = None) -> dict:
        gone = [session] if session in self.seen else list(self.seen) if session is None else []
        for s in gone:
            del self.seen[s]
        return {"cleared": len(gone)}

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        try:
            return self._read("nodes"), self._read("edges")
        except Exception as lost:
            raise ServiceError("GRAPH_UNAVAILABLE", str(lost)[:200]) from lost

    def find_callers(self, name: str, limit: int = 50) -> dict:
        nodes, edges = self._graph()
        hits = edges.where("relation = 'CALLS'").join(nodes.where(F.col("name") == self._text(name, "name")), F.col("dst") == F.col("id"))
        return {"callers": [r["src"] for r in hits.select("src").distinct().orderBy("src").limit(checked_limit(limit)).collect()]}

    def impact_analysis(self, path: str, limit: int = 50) -> dict:
        _, edges = self._graph()
        hits = edges.where((F.col("relation") == "IMPORTS") & (F.col("dst") == self._text(path, "path")))
        return {"dependents": [r["src"] for r in hits.select("src").distinct().orderBy("src").limit(checked_limit(limit)).collect()]}

    def graph_search(self, path: str, limit: int = 50) -> dict:
        nodes, edges = self._graph()
        hits = edges.where((F.col("relation") == "CONTAINS") & (F.col("src") == self._text(path, "path"))).join(nodes, F.col("dst") == F.col("id"))
        return {"symbols": [r.asDict() for r in hits.select("name", "kind").distinct().orderBy("name").limit(checked_limit(limit)).collect()]}

    def call_chain(self, start: str, goal: str, max_depth: int = 10) -> dict:
        nodes, edges = self._graph()
        return {"chain": graph.call_path(edges, nodes, self._text(start, "start"), self._text(goal, "goal"), max_depth)}


def lexical_scores(own: index.Index, terms: list[str]) -> DataFrame:
    """path, score by BM25; files without a term have 0, as they take part in the ranking."""
    every = own.manifest.select("path")
    return every.join(index.bm25(own, list(terms)).select("path", "score"), "path", "left").select("path", F.coalesce("score", F.lit(0.0)).alias("score")) if terms else every.withColumn("score", F.lit(0.0))
