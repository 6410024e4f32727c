"""From files to chunks and back."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packwright.sources.shared import bound_batches, spread

CHUNK = "path string, start_line int, end_line int, content string, symbols_defined array<string>, symbols_referenced array<string>, language string"
#: Characters other than white space of one chunk.
LARGE = 1500
#: What opens a body in Python, whatever its name looks like.
_DEFINED = re.compile(r"\s*(?:(?:async\s+)?def|class)\s")
_BRACED = re.compile(r"^\s*(?:export\s+|pub\s+|public\s+|private\s+|static\s+|async\s+|default\s+|abstract\s+)*(?:function\*?|class|interface|enum|struct|trait|impl|fn)\s+([A-Za-z_$][\w$]*)")
_ARROW = re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>")
_NAMES = re.compile(r"[A-Za-z_]\w*")
#: What a scan for braces meets: comments, strings (which end with their line, but for template ones), braces, and line ends after a semicolon.
_SCAN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|(?P<open>\{)|(?P<close>\})|(?P<end>;[ \t]*(?=\n|\Z))", re.S)
#: What a file imports, by language: the whole name or path.
IMPORTS = {
    "python": (r"(?m)^import +([A-Za-z0-9_.]+)", r"(?m)^from +([A-Za-z0-9_.]+) +import"),
    "javascript": (r"import +[^;'\"]*? +from +['\"]([^'\"]+)['\"]", r"require *\( *['\"]([^'\"]+)['\"] *\)"),
    "rust": (r"(?m)^use +([A-Za-z0-9_:]+)",),
}
IMPORTS["typescript"] = IMPORTS["javascript"]


def _python_chunks(path: str, content: str) -> list[tuple]:
    """Functions and classes of the top level; a class defines its methods, too. Names that a file imports are references, not calls of its own."""
    lines = content.split("\n")
    out = []
    for node in ast.parse(content).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            defined = [node.name, *(n.name for n in node.body if isinstance(node, ast.ClassDef) and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))]
            names = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)})
            out.append((path, start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno]), defined, names, "python"))
    return out


def _block_end(content: str, start: int) -> int:
    """Where the braced block that follows start ends, braces in strings and comments aside; the end of its line or statement where none opens."""
    depth = 0
    for m in _SCAN.finditer(content, start):
        if m["open"]:
            depth += 1
        elif m["close"]:
            depth -= 1
            if depth <= 0:
                return m.end()
        elif m["end"] and not depth:
            return m.end()
    if depth:
        return len(content)
    line = content.find("\n", start)
    return len(content) if line < 0 else line


def _regex_chunks(path: str, content: str, language: str) -> list[tuple]:
    lines, out, at = content.split("\n"), [], 0
    for k, line in enumerate(lines):
        if language == "python":
            m = re.match(r"(\s*)(?:async\s+def|def|class)\s+(\w+)", line)
            if m:
                end, name = k, m[2]
                for j in range(k + 1, len(lines)):
                    if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j if lines[j].strip() else end
        else:
            m = _BRACED.match(line) or _ARROW.match(line)
            if m:
                end, name = k + content.count("\n", at, _block_end(content, at)), m[1]
        if m:
            body = "\n".join(lines[k : end + 1])
            out.append((path, k + 1, end + 1, body, [name], sorted(set(_NAMES.findall(body)) - {name}), language))
        at += len(line) + 1
    return out


def file_imports(content: Column, language: str) -> Column:
    """What a file imports, in order of the forms and places; the first part of a dotted Python name."""
    found = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in IMPORTS.get(language, ())])) if language in IMPORTS else F.array().cast("array<string>")
    return F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit("."), F.lit(1))) if language == "python" else found)


def with_imports(references: Column, imports: Column) -> Column:
    """References and what their file imports, each once, in order."""
    return F.array_distinct(F.concat(references, imports))


def calls_of(references: Column, imports: Column) -> Column:
    """References that aren't imported."""
    return F.array_except(references, imports)


def split_by(chunks: DataFrame, splitter: Callable[[str, str], list[tuple[int, int]]]) -> DataFrame:
    """Chunks cut by an external splitter: splitter(content, language) gives the first and last line (from 1) of each part, symbols stay with the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                lines = (r.content or "").split("\n")
                for n, (first, last) in enumerate(splitter(r.content or "", r.language)):
                    rows.append((r.path, r.start_line + first - 1, r.start_line + last - 1, "\n".join(lines[first - 1 : last]), list(r.symbols_defined) if n == 0 else [], list(r.symbols_referenced), r.language))
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "content", "symbols_defined", "symbols_referenced", "language"])

    bound_batches(chunks.sparkSession)
    return chunks.select("path", "start_line", "end_line", "content", "symbols_defined", "symbols_referenced", "language").mapInPandas(run, CHUNK)


def chunk_code(files: DataFrame) -> DataFrame:
    """One chunk per definition. files: path, content, language.

    Python goes through its parser, and through patterns where it doesn't parse; other languages through patterns and braces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, language in zip(b["path"], b["content"], b["language"], strict=True):
                try:
                    rows += _python_chunks(path, content or "") if language == "python" else _regex_chunks(path, content or "", language)
                except (SyntaxError, ValueError, RecursionError):
                    rows += _regex_chunks(path, content or "", language)
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "content", "symbols_defined", "symbols_referenced", "language"])

    bound_batches(files.sparkSession)
    return spread(files.select("path", "content", "language")).mapInPandas(run, CHUNK)


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, start_line, end_line, symbol, content of each section under a heading; text before the first is left out.
    A file without a heading is one section, named after the file without its suffix."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    by_path = Window.partitionBy("path").orderBy("at")
    lines = lines.withColumn("section", F.sum(F.col("line").rlike(r"^#{1,6}\s+\S").cast("int")).over(by_path))
    lines = lines.withColumn("headed", F.max("section").over(Window.partitionBy("path")) > 0).where("section > 0 or not headed")
    grouped = lines.groupBy("path", "section").agg(F.max("headed").alias("headed"), F.min("at").alias("a"), F.max("at").alias("z"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    content = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return grouped.select("path", (F.col("a") + 1).alias("start_line"), (F.col("z") + 1).alias("end_line"), F.when(F.col("headed"), F.trim(F.regexp_replace(F.col("rows")[0]["line"], r"^#{1,6}\s+", ""))).otherwise(stem).alias("symbol"), content.alias("content"))


def split_large(chunks: DataFrame, limit: int = LARGE) -> DataFrame:
    """Chunks over limit cut at lines, each part as full as it can be; only the first keeps its defined symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                parts, size = [[]], 0
                for line in (r.content or "").split("\n"):
                    n = sum(map(len, line.split()))
                    if parts[-1] and size + n > limit:
                        parts.append([])
                        size = 0
                    parts[-1].append(line)
                    size += n
                at = r.start_line
                for k, part in enumerate(parts):
                    rows.append((r.path, at, at + len(part) - 1, "\n".join(part), list(r.symbols_defined) if k == 0 else [], list(r.symbols_referenced), r.language))
                    at += len(part)
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "content", "symbols_defined", "symbols_referenced", "language"])

    bound_batches(chunks.sparkSession)
    return spread(chunks.select("path", "start_line", "end_line", "content", "symbols_defined", "symbols_referenced", "language")).mapInPandas(run, CHUNK)


def enriched(path: Column, kind: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("# File: "), path, F.lit("\n# Type: "), kind, F.lit("\n# Lines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), content)


#: Words that open a statement, so no method is named so.
_STATEMENTS = tuple("if for while switch try catch else do with return throw new typeof instanceof await yield import export const let var class function interface type enum get set".split())
TOP_LEVEL = r"(?m)^(?:export +(?:default +)?)?(?:async +)?(?:abstract +class|def|class|function|const|let|var|type|enum|interface) +([A-Za-z0-9_]+)"
INNER_DEFS = r"(?m)^[ \t]+(?:async +)?(?:def|class) +([A-Za-z_][A-Za-z0-9_]*)"
METHODS = r"(?m)^[ \t]+(?:(?:public|private|protected|static|abstract|async|override|readonly) +)*([A-Za-z_][A-Za-z0-9_]*) *\([^{\n]*\{"


def toplevel_symbols(text: Column) -> Column:
    """Names that a text defines, each once: those at the start of a line, then indented Python ones, then methods whose body opens on their line."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    methods = F.filter(found(METHODS), lambda m: ~m.isin(*_STATEMENTS))
    return F.array_distinct(F.concat(found(TOP_LEVEL), found(INNER_DEFS), methods))


def file_texts(chunks: DataFrame) -> DataFrame:
    """path, text, n_chunks: contents of a file's chunks in order, joined by line feeds. chunks: path, seq, content."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return chunks.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["content"], F.lit(""))), "\n").alias("text"), F.count(F.lit(1)).alias("n_chunks"))


def pretty_print(chunks: DataFrame, whole: bool = False) -> DataFrame:
    """path, text: chunks of a file in order of line, those within another (if whole, one that is a definition) left out, joined by blank lines.
    Chunks that have a language must have one and the same."""
    if "language" in chunks.columns and chunks.select("language").distinct().limit(2).count() > 1:
        raise ValueError("chunks of several languages can't be printed as one")
    inner, outer = chunks.alias("i"), chunks.alias("o")
    within = (F.col("i.path") == F.col("o.path")) & (F.col("o.start_line") <= F.col("i.start_line")) & (F.col("i.end_line") <= F.col("o.end_line")) & (F.struct("o.start_line", "o.end_line") != F.struct("i.start_line", "i.end_line"))
    holds = F.col("o.content").rlike(r"^\s*(?:@|async\s|export\s|pub\s)*\s*(?:def|class|function|fn|struct|enum|trait|interface|impl)\b") if whole else F.lit(True)
    top = inner.join(outer, within & holds, "left_anti")
    rows = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    return top.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n\n").alias("text"))


def compress(files: DataFrame) -> DataFrame:
    """path, content by score: from 0.6 whole, from 0.3 signatures, below also docstrings; a null score is whole. files: path, content, score."""

    @F.pandas_udf("string")
    def run(content: pd.Series, path: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series([_signatures(c or "", p, s) for c, p, s in zip(content, path, score, strict=True)])

    return files.select("path", run("content", "path", F.col("score").cast("double")).alias("content"))


def _signatures(content: str, path: str, score: float) -> str:
    if pd.isna(score) or score >= 0.6 or not path.endswith((".py", ".js", ".ts", ".tsx", ".jsx")):
        return content
    lines, out, k = content.split("\n"), [], 0
    opens, mark = (_DEFINED, "# ... implementation") if path.endswith(".py") else (_BRACED, "// ... implementation")
    while k < len(lines):
        line = lines[k]
        if opens.match(line):
            indent = len(line) - len(line.lstrip())
            out.append(line)
            if path.endswith(".py"):
                j = k + 1
                while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > indent):
                    j += 1
                doc = re.match(r'\s*("""|\'\'\')', lines[k + 1]) if k + 1 < j else None
                if score < 0.3 and doc:
                    end = next((n for n in range(k + 1, j) if lines[n].count(doc[1]) >= (2 if n == k + 1 else 1)), k + 1)
                    out += lines[k + 1 : end + 1]
            else:
                at = sum(map(len, lines[:k])) + k
                j = k + content.count("\n", at, _block_end(content, at)) + 1
            out.append(" " * (indent + 4) + mark)
            k = j
        else:
            out.append(line)
            k += 1
    return "\n".join(out)
