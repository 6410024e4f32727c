"""The folder that driver and executors share, for what a plan writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset (one machine, as in tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="packwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: ends the lineage of a loop with files that outlive executors. They go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packwright/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, size: int = 32 << 20) -> DataFrame:
    """df dealt evenly over all cores if its input has at most `size` bytes a core: a small file is often one row group, which one task would read and work on alone.

    A larger input comes in many splits and stays where it is read. Rows are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if held <= size * cores else df


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at path, as text: another one after any change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


def bound_batches(spark: SparkSession, rows: int = 512, size: int = 2 << 20) -> None:
    """Arrow batches of at most so many rows and bytes: whole files must not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
