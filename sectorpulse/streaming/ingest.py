"""Streaming refresh: landing files to published table versions, and alerts after each.

Every micro-batch runs the batch refresh against the version published before it and publishes
under its own batch id. A batch that is replayed after a failure finds its version complete and
does nothing, so each input counts exactly once. No row is dropped for being late: only retention
removes rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sectorpulse.functions.text import link_key
from sectorpulse.operators.increments import append_history
from sectorpulse.operators.rankings import alert_batch, by_importance
from sectorpulse.operators.score import Lexicon, analyse
from sectorpulse.plans.refresh import RETENTION_DAYS, Config, incremental_refresh
from sectorpulse.schema import NEWS_SCHEMA, ROW_ID, repair
from sectorpulse.session import cut_lineage
from sectorpulse.sinks.snapshot import SnapshotFolder

HISTORY_SCHEMA = "seq long, link_hash string"


def landing_stream(spark: SparkSession, path: str, schema=NEWS_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of news rows as they land."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_batch_ids(batch: DataFrame) -> DataFrame:
    """Unique row ids for a micro-batch in a fixed order of its values; checkpointed to stay so."""
    ordered = repair(batch).orderBy("publish_time", "link", "title", "content", "sector", "keyword")
    return cut_lineage(ordered.withColumn(ROW_ID, F.monotonically_increasing_id()))


def version_name(batch_id: int) -> str:
    return f"{batch_id:012d}"


def refresh_batch(
    folder: SnapshotFolder,
    config: Config,
    as_of: Callable[[int], str],
    days: int = RETENTION_DAYS,
    after: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body; ``as_of(batch_id)`` gives the time a batch runs under."""

    def run(batch: DataFrame, batch_id: int) -> None:
        version = version_name(batch_id)
        if f"v={version}" not in folder.versions():
            fetched = with_batch_ids(batch)
            existing = folder.current(before=version)
            if existing is None:
                existing = fetched.limit(0)
            refreshed = incremental_refresh(existing, fetched, config, as_of(batch_id), days)
            folder.publish(refreshed.table, version)
        if after is not None:
            after(folder.current(), batch_id)

    return run


def start_refresh(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer over everything available now; call ``start()`` on it."""
    return (
        stream.writeStream.foreachBatch(body)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def unseen_links(stream: DataFrame, event_time: str, retention: str = "30 days") -> DataFrame:
    """Bounded-state variant of the link filter: a link passes once per retention span.

    Blank links are all kept: they go round the de-duplication.
    """
    keyed = stream.withColumn("link_key", link_key(F.col("link"))).withWatermark(event_time, retention)
    linked = keyed.filter("link_key != ''").dropDuplicatesWithinWatermark(["link_key"])
    return linked.unionByName(keyed.filter("link_key = ''"))


def alerts(
    history: SnapshotFolder,
    outbox: SnapshotFolder,
    as_of: Callable[[int], str],
    lexicon: Lexicon | None = None,
    deliver: Callable[[DataFrame, str], bool] | None = None,
) -> Callable[[DataFrame, int], None]:
    """After a refresh: write the alert batch, then extend the history if anything was delivered.

    A batch whose history is written is done, also when it is replayed. A batch that failed between
    delivery and history is delivered again; ``deliver`` gets the version as its idempotency key.
    """

    def run(table: DataFrame, batch_id: int) -> None:
        version = version_name(batch_id)
        if f"v={version}" in history.versions():
            return
        spark = table.sparkSession
        known = history.current(before=version)
        if known is None:
            known = spark.createDataFrame([], HISTORY_SCHEMA)
        batch = alert_batch(analyse(table, lexicon), known, as_of(batch_id))
        outbox.publish(batch, version)
        sent = spark.read.parquet(f"{outbox.path}/v={version}")
        delivered = not sent.isEmpty() and (deliver is None or deliver(sent, version))
        if delivered:
            # At most a handful of rows, in alert order.
            order = sent.orderBy(*by_importance())
            numbered = order.withColumn("seq", F.monotonically_increasing_id())
            history.publish(append_history(known, numbered, limit=None), version)

    return run
