"""Tables and logs that are whole or not there, whatever stops a writer.

Rows are written under a name that readers pass over and moved into place by one
rename that fails where the name is taken.  That is atomic on HDFS and local disks;
on an object store it is as good as the store's own rename.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Names that Spark's readers pass over begin with an underscore.
HIDDEN = "_writing-"
VERSION = re.compile(r"v(\d{10})")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, and whether it took the name: not if that exists."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    where = _files(spark, source).getUri()
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, spark._jsc.hadoopConfiguration()).rename(_path(spark, source), _path(spark, target), none)
    except Py4JJavaError as failed:
        if "FileAlreadyExistsException" in str(failed.java_exception) or _files(spark, target).exists(_path(spark, target)):
            return False
        raise
    return True


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    found = (VERSION.fullmatch(s.getPath().getName()) for s in files.listStatus(_path(spark, path)))
    return sorted(int(m.group(1)) for m in found if m)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the latest whole version."""
    numbers = _numbers(spark, path)
    return f"{path}/v{numbers[-1]:010d}" if numbers else None


def publish(rows: DataFrame, path: str, format: str = "parquet") -> str:
    """Write the rows as the next version and return its folder.  Of writers at the
    same time each gets a version of its own."""
    spark, hidden = rows.sparkSession, f"{path}/{HIDDEN}{uuid.uuid4().hex}"
    rows.write.format(format).save(hidden)
    while True:
        target = f"{path}/v{(_numbers(spark, path) or [0])[-1] + 1:010d}"
        if _move(spark, hidden, target):
            return target


def add_once(rows: DataFrame, path: str, batch: str, format: str) -> bool:
    """Add the rows to a folder as the batch of this name; False, and nothing is
    added, if the batch is there already."""
    spark = rows.sparkSession
    target, hidden = f"{path}/batch-{re.sub(r'[^A-Za-z0-9.-]', lambda m: f'%{ord(m.group()):x}.', batch)}", f"{path}/{HIDDEN}{uuid.uuid4().hex}"
    if _files(spark, target).exists(_path(spark, target)):
        return False
    rows.write.format(format).save(hidden)
    if _move(spark, hidden, target):
        return True
    _files(spark, hidden).delete(_path(spark, hidden), True)
    return False


def batches(spark: SparkSession, path: str) -> list[str]:
    """The names, as folders have them, of the batches in a folder."""
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    names = (s.getPath().getName() for s in files.listStatus(_path(spark, path)))
    return sorted(n.removeprefix("batch-") for n in names if n.startswith("batch-"))


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the latest ``keep`` versions, once nothing reads them."""
    for number in _numbers(spark, path)[: -max(keep, 1)]:
        _files(spark, path).delete(_path(spark, f"{path}/v{number:010d}"), True)
