"""Totals over micro-batches that count every batch once, as plain tables.

A batch's totals are those of the batch before and its own. They are written to two halves in turn, each with a row that
bears the batch's number and nothing else (its `n`); so a batch that is run again, because it ended before its commit, finds
what the batch before has written untouched, and writes what it wrote before. Two tables are all that is ever kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def table_at(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """The Parquet table, or None if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _half(spark: SparkSession, path: str, schema: str, half: int) -> tuple[int, DataFrame] | None:
    """(the batch that wrote it, its rows)"""
    held = table_at(spark, f"{path}/half={half}", schema)
    if held is None:
        return None
    others = [c for c in held.columns if c != "n"]
    is_mark = F.lit(True)
    for c in others:
        is_mark = is_mark & F.col(c).isNull()
    mark = held.where(is_mark).first()
    return (mark["n"], held.where(~is_mark)) if mark is not None else None


def before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame | None:
    """The totals that a batch adds to; None for the first batch. schema has a column n, and no row with that alone."""
    if number == 0:
        return None
    held = _half(spark, path, schema, (number - 1) % 2)
    if held is None or held[0] != number - 1:
        raise RuntimeError(f"{path} has nothing of batch {number - 1}, which the checkpoint says is done")
    return held[1]


def put(totals: DataFrame, path: str, number: int) -> None:
    """Writes the totals up to a batch, which may read those of the batch before."""
    mark = totals.sparkSession.range(1).select(*[(F.lit(number) if f.name == "n" else F.lit(None)).cast(f.dataType).alias(f.name) for f in totals.schema])
    totals.unionByName(mark).write.mode("overwrite").parquet(f"{path}/half={number % 2}")


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The totals over all batches so far; None before the first."""
    found = [x for half in (0, 1) if (x := _half(spark, path, schema, half))]
    return max(found, key=lambda x: x[0])[1] if found else None
