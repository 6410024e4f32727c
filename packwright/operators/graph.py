"""Symbol and file graphs: nodes(id, kind, name, file, language), edges(src, relation, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packwright.functions.text import module_suffixes, node_id, symbol_kind
from packwright.sources.shared import cut


def file_edges(chunks: DataFrame) -> DataFrame:
    """src, dst: a file refers to a symbol that another defines; the last definition (seq, path) wins. chunks: path, seq, symbols_defined, symbols_referenced."""
    defined = chunks.select("path", "seq", F.explode("symbols_defined").alias("symbol")).groupBy("symbol").agg(F.max(F.struct("seq", "path")).getField("path").alias("dst"))
    uses = chunks.select(F.col("path").alias("src"), F.explode("symbols_referenced").alias("symbol")).distinct()
    return uses.join(defined, "symbol").where("src != dst").select("src", "dst").distinct()


def nodes_of(chunks: DataFrame) -> DataFrame:
    files = chunks.select(node_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), "language").distinct()
    symbols = chunks.select("path", "language", F.explode("symbols_defined").alias("name"))
    symbols = symbols.select(node_id(F.col("path"), F.col("name")).alias("id"), symbol_kind(F.col("name")).alias("kind"), "name", F.col("path").alias("file"), "language").distinct()
    return files.unionByName(symbols)


def edges_of(chunks: DataFrame) -> DataFrame:
    """CONTAINS from file to symbol, CALLS from file to each node with a referenced name, IMPORTS to the module with the longest suffix."""
    symbols = chunks.select("path", F.explode("symbols_defined").alias("name")).distinct()
    contains = symbols.select(node_id(F.col("path")).alias("src"), F.lit("CONTAINS").alias("relation"), node_id(F.col("path"), F.col("name")).alias("dst"))
    refs = chunks.select("path", F.explode("symbols_referenced").alias("name")).distinct()
    named = symbols.select("name", node_id(F.col("path"), F.col("name")).alias("dst"))
    calls = refs.join(named, "name").select(node_id(F.col("path")).alias("src"), F.lit("CALLS").alias("relation"), "dst")
    imports = resolve_modules(refs.select("path", F.col("name").alias("ref")), chunks.select(F.col("path").alias("file")).distinct())
    imports = imports.where("path != file").select(node_id(F.col("path")).alias("src"), F.lit("IMPORTS").alias("relation"), node_id(F.col("file")).alias("dst"))
    return contains.unionByName(calls).unionByName(imports).distinct()


def resolve_modules(refs: DataFrame, files: DataFrame) -> DataFrame:
    """path, ref, file: the longest dotted suffix of ref that is a suffix of a file's module; of several files the last by name."""
    modules = files.select("file", F.explode(module_suffixes(F.col("file"))).alias("suffix")).groupBy("suffix").agg(F.max("file").alias("file"))
    dotted = F.split("ref", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda i: F.struct((F.size(dotted) - i + 1).alias("length"), F.array_join(F.slice(dotted, i, F.size(dotted) - i + 1), ".").alias("suffix")))
    # only references whose last part ends some module are tried at all
    last = modules.where(~F.contains(F.col("suffix"), F.lit("."))).select(F.col("suffix").alias("last"))
    refs = refs.withColumn("last", F.element_at(F.split("ref", r"\."), -1)).join(last, "last", "left_semi")
    tried = refs.select("path", "ref", F.explode(suffix).alias("s")).select("path", "ref", "s.*")
    best = tried.join(modules, "suffix").groupBy("path", "ref").agg(F.max(F.struct("length", "file")).getField("file").alias("file"))
    return best


def neighbours(edges: DataFrame) -> DataFrame:
    """id, successors, predecessors: sorted sets."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))
    empty = F.array().cast("array<string>")
    return out.join(into, "id", "full_outer").select("id", F.coalesce("successors", empty).alias("successors"), F.coalesce("predecessors", empty).alias("predecessors"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """issue, subject: duplicate ids, dangling ends, orphan symbols, CALLS to a file, IMPORTS to what isn't one."""
    ids = nodes.select("id", "kind").distinct()
    issue = lambda df, name, col: df.select(F.lit(name).alias("issue"), F.col(col).alias("subject"))
    found = issue(nodes.groupBy("id").count().where("count > 1"), "duplicate_id", "id")
    for end in ("src", "dst"):
        found = found.unionByName(issue(edges.join(ids, edges[end] == ids["id"], "left_anti").select(end).distinct(), f"dangling_{end}", end))
    held = edges.where("relation = 'CONTAINS'")
    found = found.unionByName(issue(nodes.where("kind != 'file'").join(held, F.col("id") == F.col("dst"), "left_anti").select("id").distinct(), "orphan_symbol", "id"))
    to = edges.join(ids, F.col("dst") == F.col("id"))
    found = found.unionByName(issue(to.where("relation = 'CALLS' and kind = 'file'").select("dst").distinct(), "call_to_file", "dst"))
    return found.unionByName(issue(to.where("relation = 'IMPORTS' and kind != 'file'").select("dst").distinct(), "import_of_symbol", "dst"))


def reach(edges: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """node, hops, route (joined by ->): shortest route from start to each node, the first by text among equals. One join a hop."""
    spark = edges.sparkSession
    links = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(start, 0, start)], "node string, hops int, route string")
    frontier = seen
    for hop in range(1, max_depth + 1):
        found = frontier.join(links, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.concat_ws("->", "route", "dst")).alias("route"))
        frontier = cut(found.join(seen, F.col("dst") == F.col("node"), "left_anti").select(F.col("dst").alias("node"), F.lit(hop).alias("hops"), "route"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


#: Distinct edges up to which one task takes all of PageRank's rounds.
ONE_TASK_EDGES = 2_000_000


def pagerank(
    edges: DataFrame, rounds: int = 100, damping: float = 0.85, boosted: DataFrame | None = None, boost: float = 2.0,
    tolerance: float = 1e-6, spread: bool = True, one_task: int = ONE_TASK_EDGES,
) -> DataFrame:
    """node, rank: power iteration over distinct edges until ranks change by less than tolerance in all, or for `rounds` rounds.

    The rank of nodes without successors is spread over all, or lost (spread=False); at the end ranks are brought to sum 1.
    Up to one_task edges are gathered in one task, which takes all rounds in arrays; more go through a join and a sum a round, with edges
    kept by source and ranks written. boosted: node, whose rank counts `boost` times before the ranks are brought to sum 1."""
    links = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    few = links.count() <= one_task
    ranks = _ranks_in_a_task(links, rounds, damping, tolerance, spread) if few else _ranks_by_joins(links, rounds, damping, tolerance, spread)
    if boosted is not None:
        hit = boosted.select("node").distinct().withColumn("hit", F.lit(True))
        ranks = ranks.join(hit, "node", "left").select("node", F.when(F.col("hit"), F.col("rank") * boost).otherwise(F.col("rank")).alias("rank"))
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # one row


def _ranks_in_a_task(links: DataFrame, rounds: int, damping: float, tolerance: float, spread: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype=object), *batches], ignore_index=True)
        if held.empty:
            return
        codes, names = pd.factorize(pd.concat([held["src"], held["dst"]], ignore_index=True))
        src, dst, n = codes[: len(held)], codes[len(held) :], len(names)
        degree = np.bincount(src, minlength=n)
        share = 1.0 / degree[src]
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            lost = rank[degree == 0].sum() if spread else 0.0
            new = (1 - damping) / n + damping * (np.bincount(dst, rank[src] * share, minlength=n) + lost / n)
            moved, rank = np.abs(new - rank).sum(), new
            if moved < tolerance:
                break
        yield pd.DataFrame({"node": names, "rank": rank})

    return cut(links.coalesce(1).mapInPandas(run, "node string, rank double"))


def _ranks_by_joins(links: DataFrame, rounds: int, damping: float, tolerance: float, spread: bool) -> DataFrame:
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    held = links.join(degree, "src").repartition("src").persist()
    nodes = cut(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = max(1, nodes.count())
    ranks, mass = nodes.withColumn("rank", F.lit(1.0 / n)), 1.0
    for _ in range(rounds):
        given = held.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        both = cut(ranks.join(given, "node", "left").select("node", F.col("rank").alias("was"), F.coalesce("given", F.lit(0.0)).alias("given")))
        # what isn't given on is what nodes without successors had
        kept = both.agg(F.sum("given")).first()[0] or 0.0
        base = (1 - damping) / n + (damping * (mass - kept) / n if spread else 0.0)
        ranks = both.select("node", (base + damping * F.col("given")).alias("rank"))
        mass = base * n + damping * kept
        if tolerance and (both.agg(F.sum(F.abs(base + damping * F.col("given") - F.col("was")))).first()[0] or 0.0) < tolerance:
            break
    ranks = cut(ranks)
    held.unpersist()
    return ranks


_memo: dict[tuple, DataFrame] = {}


def pagerank_once(key: str, edges: DataFrame, changed: tuple[str, ...] = (), **options) -> DataFrame:
    """pagerank() of the graph that key names, with changed nodes boosted; kept for the session by both, in the shared folder."""
    spark = edges.sparkSession
    at = (spark.sparkContext.applicationId, key, tuple(sorted(changed)), tuple(sorted(options.items())))
    if at not in _memo:
        boosted = spark.createDataFrame([(c,) for c in sorted(changed)], "node string") if changed else None
        _memo[at] = cut(pagerank(edges, boosted=boosted, **options))
    return _memo[at]


def call_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, max_depth: int = 10) -> list[str]:
    """The shortest chain of function names from start to goal: the files that contain a name, then the names that those files call. [start] if equal; [] if none is found within max_depth (at most 10)."""
    if start == goal:
        return [start]
    names = nodes.where("kind != 'file'").select("id", "name")
    holds = edges.where("relation = 'CONTAINS'").join(names, F.col("dst") == F.col("id")).select(F.col("name").alias("caller"), F.col("src").alias("file"))
    calls = edges.where("relation = 'CALLS'").join(names, F.col("dst") == F.col("id")).select(F.col("src").alias("file"), F.col("name").alias("callee"))
    steps = holds.join(calls, "file").where("caller != callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    found = reach(steps, start, min(max_depth, 10)).where(F.col("node") == goal).select("route").first()
    return found["route"].split("->") if found else []


def augment(scores: DataFrame, graph_files: DataFrame, factor: float = 0.3) -> DataFrame:
    """Add files of the graph that the list lacks, at factor of its best score."""
    top = scores.agg((F.max("score") * factor).alias("score"))
    return scores.unionByName(graph_files.select("path").distinct().join(scores, "path", "left_anti").crossJoin(F.broadcast(top)))  # one row
