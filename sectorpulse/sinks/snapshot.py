"""Published versions of the news table, and keyed replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorpulse.functions.ids import row_key
from sectorpulse.schema import NEWS_COLUMNS, ROW_ID


class SnapshotFolder:
    """Parquet versions under one folder; the newest complete one is current.

    A version counts once Spark has committed it (its success marker exists), so readers never see
    half a table and the version being read is never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def versions(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(hadoop) or []
        return sorted(status.getPath().getParent().getName() for status in found)

    def current(self, before: str | None = None) -> DataFrame | None:
        """The newest version (older than ``before``), or None when there is none."""
        names = [v for v in self.versions() if before is None or v < f"v={before}"]
        return self.spark.read.parquet(f"{self.path}/{names[-1]}") if names else None

    def publish(self, df: DataFrame, version: str) -> bool:
        """Write a version; writing one that is already complete does nothing."""
        if f"v={version}" in self.versions():
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return True

    def clear(self, version: str, like: DataFrame) -> bool:
        """Publish an empty version."""
        return self.publish(like.limit(0), version)


def last_per_key(df: DataFrame) -> DataFrame:
    """One row per identity, the last one (highest row id) wins; reduced before the shuffle."""
    columns = [ROW_ID, *NEWS_COLUMNS]
    latest = F.max_by(F.struct(*columns), F.col(ROW_ID)).alias("row")
    return df.withColumn("id", row_key()).groupBy("id").agg(latest).select("id", "row.*")


def replacement_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to insert, update and delete when ``new`` replaces ``old`` (both one row per id)."""
    before = old.select("id", F.lit(True).alias("was"))
    after = new.select("id", F.lit(True).alias("now"))
    both = before.join(after, "id", "full")
    return both.agg(
        F.count_if(F.col("was").isNull()).alias("inserted"),
        F.count_if(F.col("was") & F.col("now")).alias("updated"),
        F.count_if(F.col("now").isNull()).alias("deleted"),
    )


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities that disappear."""
    return old.select("id").distinct().join(new.select("id"), "id", "left_anti")
