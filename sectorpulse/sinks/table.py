"""The stored news table: typed columns and keys, one partition of Parquet files a publish date.

Rows carry their publish time as a timestamp and the keys that later batches are compared by. Rows without
a readable time have a partition of their own. Changes rewrite the dates they touch, by Spark's dynamic
partition overwrite; other dates' files stay as they are, and dates without rows left are removed. A date's
rows are replaced in one commit, several dates one after another: a batch that is cut off in between is
given again under its id and first takes back what it had written.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorpulse.operators.delta import KEY_COLUMNS
from sectorpulse.operators.filters import PUBLISH_DATE, published
from sectorpulse.schema import NEWS_COLUMNS, ROW_ID

STORED_SCHEMA = T.StructType([
    T.StructField(ROW_ID, T.LongType()),
    *[T.StructField(c, T.StringType()) for c in NEWS_COLUMNS],
    T.StructField("publish_ts", T.TimestampNTZType()),
    T.StructField("keys", T.ArrayType(T.BinaryType())),
    T.StructField("story_title", T.StringType()),
    T.StructField("story_link", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField(PUBLISH_DATE, T.DateType()),
])
#: Fixed value: what Spark names the partition of NULL.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def on_dates(dates: set[date | None]) -> Column:
    """A partition filter for some dates, the undated partition (None) among them."""
    day = F.col(PUBLISH_DATE)
    test = day.isin([d for d in dates if d is not None])
    return test | day.isNull() if None in dates else test & day.isNotNull()


class NewsTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.rows = f"{self.path}/rows"

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def dates(self) -> set[date | None]:
        """Dates with a partition, None for the undated one; empty before the first write."""
        files, folder = self._folder(f"{self.rows}/{PUBLISH_DATE}=*")
        names = [s.getPath().getName().split("=", 1)[1] for s in files.globStatus(folder) or []]
        return {None if n == NO_DATE else date.fromisoformat(n) for n in names}

    def read(self) -> DataFrame:
        """All rows; filters on ``publish_date`` choose partitions. A missing table is an empty one."""
        if not self.dates():
            return self.spark.createDataFrame([], STORED_SCHEMA)
        return self.spark.read.schema(STORED_SCHEMA).option("basePath", self.rows).parquet(self.rows)

    def typed(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """Rows ``with_keys`` in the stored shape."""
        seen = published()
        return df.select(
            ROW_ID,
            *NEWS_COLUMNS,
            seen.alias("publish_ts"),
            *KEY_COLUMNS,
            (F.col("batch") if "batch" in df.columns else F.lit(batch).cast("long")).alias("batch"),
            F.to_date(seen).alias(PUBLISH_DATE),
        )

    def replace(self, df: DataFrame, dates: set[date | None]) -> None:
        """``df`` (stored shape) becomes the whole content of ``dates``; it may be read from this table."""
        # Large dates are split into several files, small ones are not strewn over all tasks.
        laid = df.hint("rebalance", PUBLISH_DATE)
        writer = laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PUBLISH_DATE)
        before = self._marks(dates)
        writer.parquet(self.rows)
        # A date that got no rows still has the files it had.
        self._remove({d for d, mark in self._marks(dates).items() if mark == before.get(d)})

    def _marks(self, dates: set[date | None]) -> dict[date | None, str]:
        """Names of the files of those dates that exist."""
        marks = {}
        for day in dates & self.dates():
            files, folder = self._folder(self._partition(day))
            names = sorted(s.getPath().getName() for s in files.listStatus(folder))
            marks[day] = hashlib.sha256("\n".join(names).encode()).hexdigest()
        return marks

    def _partition(self, day: date | None) -> str:
        return f"{self.rows}/{PUBLISH_DATE}={NO_DATE if day is None else day.isoformat()}"

    def _remove(self, dates: set[date | None]) -> None:
        for day in dates:
            files, folder = self._folder(self._partition(day))
            files.delete(folder, True)

    def expire(self, before: date) -> int:
        """Remove the partitions of earlier days; the number of their rows."""
        old = {d for d in self.dates() if d is not None and d < before}
        if not old:
            return 0
        n = self.read().filter(on_dates(old)).count()
        self._remove(old)
        return n

    def rules(self) -> str | None:
        """What ``set_rules`` noted last."""
        files, folder = self._folder(f"{self.path}/rules/_SUCCESS")
        return self.spark.read.parquet(f"{self.path}/rules").first()["rules"] if files.exists(folder) else None

    def set_rules(self, rules: str) -> None:
        self.spark.createDataFrame([(rules,)], "rules string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rules")
