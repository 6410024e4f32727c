"""Command line: python -m packwright index|search|pack|status|callers|impact ROOT ... ; one JSON object a line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from packwright.plans.service import Service, index_tree
from packwright.sources.sinks import error_line, status_line


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="packwright")
    p.add_argument("command", choices=["index", "search", "pack", "status", "domains", "callers", "impact"])
    p.add_argument("root", help="folder or URL of the files")
    p.add_argument("ask", nargs="?", default="", help="a query, name or path")
    p.add_argument("--index", help="where the index is (default: ROOT/.packwright)")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--format", default="xml")
    p.add_argument("--budget", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("packwright").getOrCreate()
    folder = a.index or f"{a.root.rstrip('/')}/.packwright"
    if a.command == "index":
        print(status_line("rebuilt" if index_tree(spark, a.root, folder) else "current", index=folder))
        return 0
    tool, arguments = {
        "search": ("search_codebase", {"query": a.ask, "limit": a.limit}), "pack": ("pack_context", {"query": a.ask, "format": a.format, "token_budget": a.budget}),
        "status": ("get_index_status", {}), "domains": ("get_domain_map", {}), "callers": ("find_callers", {"name": a.ask}), "impact": ("impact_analysis", {"path": a.ask}),
    }[a.command]
    answer = Service(spark, a.root, folder).call(tool, arguments)
    if "error" in answer:
        print(error_line(answer["error"], answer["message"]))
        return 1
    if a.command == "pack":
        print(answer["pack"])
    else:
        for row in answer.get("results", [answer]):
            print(json.dumps({"type": "result", **row}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
