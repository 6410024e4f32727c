"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes of one Arrow batch: very long texts must not add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
#: How files below a shared folder of scheme file are written: without a checksum file beside each, as Hadoop starts one process more (chmod) for each of those.
#: Parquet's own checksums of pages are verified instead, whatever the scheme.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_pandas(df: DataFrame, step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], ddl: str) -> DataFrame:
    """mapInPandas whose 64-bit integers stay exact beside nulls (as Int64, not as floats)."""
    out = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in step(b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches):
            yield pa.RecordBatch.from_pandas(made, schema=out, preserve_index=False)

    return df.mapInArrow(run, ddl)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="packwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below shared_dir(), deleted when the driver ends."""
    path = f"{shared_dir(spark)}/packwright/{uuid.uuid4().hex}/{label}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(compression=codec, **LOCAL_FILES).parquet(path)
    return spark.read.options(**VERIFIED).schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words whose output bits are well mixed."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_word_chars: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def is_word_char(codes: np.ndarray) -> np.ndarray:
    """For code points: letter, number or underscore, as str.isalnum() has them."""
    if not _word_chars:
        _word_chars.append(np.frombuffer(bytes(chr(i).isalnum() or i == 95 for i in range(0x110000)), np.uint8).astype(bool))
    return _word_chars[0][codes]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, in order, and where each text's words begin (one more entry than texts).

    Words are maximal runs of letters, numbers and underscores of the lower-cased
    text. A polynomial prefix sum gives every word's hash without a loop over words."""
    parts = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts_of_text = np.cumsum([0] + [len(p) + 1 for p in parts])
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    inside = is_word_char(codes)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
    h = mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, starts_of_text)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text, and the bounds of each text's runs.

    A text of 1 to n - 1 words has one run: all its words. A text without words has none."""
    count = np.diff(bounds)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    text = np.repeat(np.arange(len(count)), runs)
    first = bounds[:-1][text] + (np.arange(out_bounds[-1]) - out_bounds[:-1][text])
    length = np.minimum(count[text], n)
    h = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        step = h * np.uint64(_BASE) + padded[first + k]
        h = np.where(k < length, step, h)
    return mix64(h), out_bounds
