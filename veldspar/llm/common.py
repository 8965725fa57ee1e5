"""Shared plumbing of the training-data operators: tables, scratch space, text rules."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words in the plain word rule `[^\x20\x09-\x0D]+`.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on one machine only (tests), a local folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        import shutil

        _own.append(tempfile.mkdtemp(prefix="veldspar-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        os.makedirs(_own[0], exist_ok=True)
    return "file://" + _own[0]


def session_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_folder(spark)}/veldspar/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and lost
    executors cost no recomputation beyond this table."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and nothing reads any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/veldspar/" in f:
            delete(df.sparkSession, f)


def release() -> None:
    """Give a Python worker's free memory back: it may idle on beside the next stage."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application's operators left in the shared folder, and no
    other's; results must be stored by then."""
    delete(spark, session_folder(spark))


class Bucketed:
    """A table in the shared folder, dealt to buckets by a hash of its keys: joins on the keys
    read it without a shuffle, and where it is sorted, merge it without a sort.

    rows should come dealt by these keys to as many partitions, as a groupBy() on them does
    where `buckets` is the number of shuffle partitions; else a bucket has several files.
    """

    def __init__(self, rows: DataFrame, buckets: int, *keys: str, ordered: bool = False):
        self.spark, self.schema, self.buckets = rows.sparkSession, rows.schema, buckets
        self.name = f"veldspar_{uuid.uuid4().hex}"
        self.path = f"{session_folder(self.spark)}/{self.name}"
        out = rows.write.bucketBy(buckets, *keys)
        (out.sortBy(*keys) if ordered else out).option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The rows as a plain table, known to the catalogue no more."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
