"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one machine (tests) takes a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumatab-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def home(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{root(spark)}/lumatab/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{home(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read back, and the table's path.

    Lost executors lose no part of it, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Steps:
    """Tables of one computation's steps."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, self.paths[name] = written(df, name)
        return out

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            drop(self.spark, self.paths.pop(name))


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Tables that are dropped at the end: what is returned must not read them."""
    made = Steps(spark)
    try:
        yield made
    finally:
        made.drop()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table or file of the shared folder, by the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file from the driver, by the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession) -> None:
    """Removes every table and file that this application has left under the shared folder; results not read yet are lost."""
    drop(spark, home(spark))
