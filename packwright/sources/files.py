"""File trees as tables, and the globs that choose from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = ("py", "js", "jsx", "ts", "tsx", "rs", "java", "cs")
MARKDOWN = ("md", "markdown", "mdx")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = CODE + MARKDOWN, dotted: bool = False) -> DataFrame:
    """path (relative to root), content, mtime, size of all files below root with these extensions; names that begin with a dot only if dotted.

    Spark's own listing leaves out names that begin with _ or a dot; those are listed by the driver and read by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    plain = files.select(path.alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rest = [f for f in _listed(spark, root) if f[1].endswith(tuple("." + e for e in extensions)) and _skipped(f[1]) and (dotted or not re.search(r"(^|/)\.", f[1]))]
    if rest:
        names = spark.createDataFrame(rest, "uri string, path string, ms long, size long").repartition(min(len(rest), spark.sparkContext.defaultParallelism))
        plain = plain.unionByName(names.mapInPandas(_read, "path string, content binary, ms long, size long").select("path", "content", F.timestamp_millis("ms").alias("mtime"), "size"))
    return plain.withColumn("content", tolerant_text(F.col("content")))


def _skipped(path: str) -> bool:
    return any(p[:1] == "." or p[:1] == "_" and "=" not in p for p in path.split("/"))


def _listed(spark: SparkSession, root: str) -> Iterator[tuple[str, str, int, int]]:
    """uri, path below root, mtime in ms and size of all files below root."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found = system.makeQualified(top).toString().rstrip("/") + "/", system.listFiles(top, True)
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        yield uri, uri[len(top) :], f.getModificationTime(), f.getLen()


def _bytes_of(uri: str) -> bytes:
    system, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    with system.open_input_file(path) as f:
        return f.read()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(len(b)):
            one = b.iloc[k : k + 1]
            yield pd.DataFrame({"path": one["path"], "content": [_bytes_of(u) for u in one["uri"]], "ms": one["ms"], "size": one["size"]})


def tolerant_text(raw: Column) -> Column:
    """UTF-8 if valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def glob_regex(glob: str) -> str:
    """A glob as a regex over whole paths: * crosses slashes, ? is one character, a leading **/ may be nothing."""
    out, i = "", 0
    if glob.startswith("**/"):
        out, glob = "(.*/)?", glob[3:]
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += ".*"
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """Globs of an ignore file: no blanks, comments or negations; a folder covers what is in it."""
    out = []
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if line and line[0] not in "#!":
            line = line.lstrip("/")
            out.append(line + "**" if line.endswith("/") else line)
    return out


def filter_globs(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Files that no exclude glob fits and an include glob does."""
    fits = lambda globs: F.col("path").rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
    return files.where(~fits(exclude) & fits(include))


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = CODE + MARKDOWN, hidden: bool = False) -> DataFrame:
    """scan_files without what the ignore file of root covers; names that begin with a dot only if hidden."""
    own = [uri for uri, path, _, _ in _listed(spark, root) if path == ".gitignore"]
    globs = [g for uri in own for p in ignore_patterns(_bytes_of(uri).decode(errors="ignore")) for g in (p, "**/" + p)]
    return filter_globs(scan_files(spark, root, extensions, hidden), ["*"], globs)


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''")
