"""Token files: flat unsigned integers with 64-bit document offsets, in ascending doc_id order over all shards."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packwright.llm.common import bound_batches, map_pandas, materialize, new_path
from packwright.llm.tokens import Encoder

END_ID = 1
#: Bytes of text of one shard, about: at least (or there is a shard for each shuffle partition) and at most.
LEAST_BYTES, SHARD_BYTES = 1 << 20, 256 << 20
#: Shards whose bases are summed in one task; documents and ids that are read at once.
GROUP_SHARDS, READ_DOCS, READ_IDS = 1024, 1024, 1 << 20
MANIFEST = "shard int, name string, n_docs long, n_tokens long"


def open_store(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def open_flat(url: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """Reads numbers a to z of a file: memory-mapped where the store is a mounted folder, else by ranges."""
    fs, path = open_store(url)
    if urlsplit(url).scheme in ("", "file"):
        path = unquote(urlsplit(url).path)
        mapped = np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.zeros(0, dtype)
        return lambda a, z: mapped[a:z]
    f, width = fs.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, z: np.frombuffer(f.read_at((z - a) * width, a * width), dtype)


def write_shards(documents: DataFrame, folder: str, tokenizer: str, dtype: str, end_id: int = END_ID) -> DataFrame:
    """Write three files for each range of doc_id and return the manifest, one row per shard, shards numbered in the order of their documents.

    name.bin: ids (dtype, little-endian); name.idx: n_docs + 1 offsets (int64, in
    tokens); name.doc: doc_id (int64, the least value for null). Each attempt of a task writes under its own name,
    and only the name that the manifest has counts, so a lost executor or a second
    attempt leaves no harm."""
    limit = np.iinfo(np.dtype(dtype)).max

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], dtype).tobytes()
        fs, base = open_store(folder)
        name, docs, ends, out = uuid.uuid4().hex, array("q"), array("q", [0]), None
        for b in batches:
            out = out or fs.open_output_stream(f"{base}/{name}.bin")
            for doc, said in zip(b["doc_id"], encoder.encode_many([t or "" for t in b["text"]]), strict=True):
                ids = np.frombuffer(said, "<u4")
                if len(ids) and ids.max() > limit:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                out.write(ids.astype(dtype).tobytes() + end)
                docs.append(int(doc))
                ends.append(ends[-1] + len(ids) + 1)
        if out:
            out.close()
            for kind, values in (("idx", ends), ("doc", docs)):
                with fs.open_output_stream(f"{base}/{name}.{kind}") as f:
                    f.write(np.array(values, "<i8").tobytes())
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "name": [name], "n_docs": [len(docs)], "n_tokens": [ends[-1]]})

    bound_batches(documents.sparkSession)
    least = F.lit(-(2**63)).cast("long")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    few = min(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES))
    shards = max(1, few, -(-size // SHARD_BYTES))
    # the last key parts rows that are alike, should they be many
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(shards), "doc_id", "hash", "at").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    fs, base = open_store(folder)
    fs.create_dir(base, recursive=True)
    return materialize(rows.transform(map_pandas, write, MANIFEST), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the ids of all shards before each: sums within groups of shards, and over the groups, so no task has them all."""
    grouped = manifest.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("group").agg(F.sum("n_tokens").alias("total"))
    ahead = sums.select("group", F.coalesce(F.sum("total").over(before(Window.orderBy("group"))), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("group").orderBy("shard"))), F.lit(0))
    return grouped.withColumn("own", own).join(F.broadcast(ahead), "group").select("shard", "name", "n_docs", "n_tokens", (F.col("own") + F.col("ahead")).alias("base"))  # a row for GROUP_SHARDS shards


def read_shards(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base, n_docs in zip(batch["name"], batch["base"].astype(int), batch["n_docs"].astype(int), strict=True):
                ids, offsets, docs = (open_flat(f"{folder}/{name}.{kind}", t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for at in range(0, n_docs, READ_DOCS):
                    span = np.array(offsets(at, min(at + READ_DOCS, n_docs) + 1))
                    doc, crc, held = pd.Series(np.array(docs(at, at + len(span) - 1))).astype("Int64"), [], None
                    for s, e in zip(span[:-1].tolist(), span[1:].tolist(), strict=True):
                        if held is None or e > held[1]:
                            upto = max(e, min(int(span[-1]), s + READ_IDS))
                            held = (s, upto, ids(s, upto))
                        crc.append(zlib.crc32(held[2][s - held[0] : e - held[0]].astype("<u4").tobytes()))
                    yield pd.DataFrame({"doc_id": doc.mask(doc == -(2**63)), "start": base + span[:-1], "n_tokens": np.diff(span), "ids_crc32": crc})

    placed = with_bases(manifest).select("name", "base", "n_docs")
    return placed.repartition(max(1, manifest.count())).transform(map_pandas, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, dtype: str = "<u2", end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the token files of all documents and return what they hold, per document.

    Null and empty texts have end_id alone. Rows with one doc_id follow each other in
    an order that depends on their texts; a null doc_id comes first. Other columns are left out; an empty table gives no
    shard and no row. dtype must hold the vocabulary (uint16 for up to 65,536 ids), else the
    task fails. folder: where the files go, by default in the shared folder, until the driver ends."""
    folder = folder or new_path(documents.sparkSession, "tokens")
    return read_shards(write_shards(documents, folder, tokenizer, dtype, end_id), folder, dtype)
