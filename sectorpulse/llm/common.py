"""Helpers the training-data operators share: shared folders, written stages, bounded memos."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorpulse.session import ensure_checkpoint_dir

#: Entries a memo of a Python worker holds at most; about 60 MB with short words as keys.
MEMO_ENTRIES = 300_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at a time. Spark's 64 MB are held several times over, by the
#: JVM outside its heap and by the worker, for every core.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by ``BATCH_BYTES``, unless the session was given a figure of its own."""
    if spark.conf.get(_BATCH_BYTES_CONF, None) is None:
        spark.conf.set(_BATCH_BYTES_CONF, str(BATCH_BYTES))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what was written outlives the loss of executors.
    """
    bound_batches(df.sparkSession)
    folder = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies has a file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Parquet settings for rows of several MB: look at the buffered size after each row.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "4",
    "parquet.enable.dictionary": "false",
}


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Keys (whole numbers) that are broadcast at most, some 50 MB; beyond, a join shuffles both sides.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``column`` is not among the distinct ``keys``."""
    keys = written(keys, "keys")
    small = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, column, "left_anti")


def sorted_unique(values: np.ndarray) -> np.ndarray:
    """``np.unique`` by a sort, which for integers is faster than its hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


_MEMOS: list[Memo] = []
_OWNER: list[str] = [""]


def own_memos(operator: str) -> None:
    """Called by a task: a worker that goes from one operator to another forgets what the other held."""
    if _OWNER[0] != operator:
        _OWNER[0] = operator
        for memo in _MEMOS:
            memo.clear()
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """A bounded memo of a pure function; frequent keys come early, so the first ones stay."""

    def __init__(self, function: Callable | None = None, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries = function, entries
        _MEMOS.append(self)

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.entries:
            self[key] = value
        return value
