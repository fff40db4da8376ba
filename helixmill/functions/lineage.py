"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's; one of our own only where neither is set and Spark is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        import tempfile

        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="helixmill-checkpoints-")
        context.setCheckpointDir(found)  # for the next call
    return found.rstrip("/")


def cut(df: DataFrame, **options) -> DataFrame:
    """df computed and kept there as Parquet (with options of the writer): what comes after doesn't depend on what came before, and a lost executor costs what it ran."""
    path = f"{shared_dir(df.sparkSession)}/helixmill-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A cut() for tables that are needed until what is made of them is written; on leaving, they are deleted."""
    folder = f"{shared_dir(spark)}/helixmill-{uuid.uuid4().hex}"
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(f"{folder}/{len(made)}")
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
