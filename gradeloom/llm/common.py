"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and its master is local, a temporary folder becomes it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    The files survive the loss of any executor. They are scratch data of the session and go with its
    checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give the system back what this process has freed, of Arrow's pool and, where the C library can, of its heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forgetful(forget: Callable[[], None] = lambda: None) -> Callable:
    """For the work of a task on batches: what the worker has kept of its texts goes when the task ends.

    Spark keeps Python workers and gives them tasks of any stage, so what stages keep or have freed without giving
    it back would add up, beside an executor's heap that is at its most.
    """

    def wrap(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            release()
            try:
                yield from work(batches)
            finally:
                forget()
                release()

        return run

    return wrap


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
