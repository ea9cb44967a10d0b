"""Cutting lineage with tables in the folder that all executors share.

A loop whose state is a DataFrame must not grow its plan for ever, and what it has computed must
survive the loss of an executor.  ``cut`` writes the state as Parquet below ``spark.checkpoint.dir``
and reads it back with the known schema (no job for schema inference, one pass over the data).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting; it then gets a temporary folder, since there
    driver and executors are one process.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame that came from ``cut``; its successor is written."""
    path = getattr(df, "_weft_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.pop(path, None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for state of several tables; deleted when the process ends."""
    path = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any Hadoop file system; null if there is none."""
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one."""
    jvm = spark._jvm
    where, fs = _file_system(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    options[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, where, options)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaning applies
            pass
