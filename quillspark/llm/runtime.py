"""Shared plumbing: the folder all executors see, staged tables, byte streams."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and
    one machine runs everything (tests, a laptop) a temporary folder is made and
    set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    so a lost executor costs one read and never a recomputation."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to, now
    and not when the driver next happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class SharedFiles:
    """Binary files under a URI of the shared folder, written from executors.

    Local schemes use the file system; others go through pyarrow's.  A file is
    written under a private name and moved into place when it is whole, so a
    killed or repeated task never leaves a torn one.
    """

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        parsed = urlparse(self.uri)
        self.local = unquote(parsed.path) if parsed.scheme in ("", "file") else None

    def write(self, name: str, chunks) -> int:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            temp = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            with open(temp, "wb") as out:
                size = sum(out.write(c) for c in chunks)
            os.replace(temp, f"{self.local}/{name}")
            return size
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        temp = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            size = 0
            for c in chunks:
                out.write(c)
                size += len(c)
        store.move(temp, f"{root}/{name}")
        return size
