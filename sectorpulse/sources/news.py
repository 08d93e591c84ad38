"""The stored news table as a source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sectorpulse.schema import NEWS_SCHEMA, repair


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, blanks kept blank. An unreadable path raises: merging onto a table
    that only looks empty would lose it. Line breaks inside quotes need ``multi_line``, which makes a
    file one task; without them large files are split. Convert to Parquet once at ingest."""
    options = {"header": True, "emptyValue": "", "nullValue": "\x00", "multiLine": multi_line, "escape": '"'}
    return repair(spark.read.options(**options).schema(NEWS_SCHEMA).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return repair(spark.read.parquet(path))


#: Conditions of a table that was never written, as opposed to one that cannot be read.
_NEVER_WRITTEN = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def read_or_start(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame] = read_parquet) -> DataFrame:
    """The table at ``path``; an empty one if nothing was ever written there. Other failures raise."""
    try:
        return read(spark, path)
    except AnalysisException as error:
        if error.getCondition() not in _NEVER_WRITTEN:
            raise
        return repair(spark.createDataFrame([], NEWS_SCHEMA))
