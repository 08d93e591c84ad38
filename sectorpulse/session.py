"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sectorpulse", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session the cluster hands out."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Spark applies that setting itself at start-up. Only a local session without it gets a
    temporary folder; on a cluster a missing setting is an error, because executors would lose
    checkpoints kept on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sectorpulse-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written once into the shared checkpoint folder and read back: survives the loss of executors.

    Parquet and not a checkpoint of rows: later steps read only the columns they need, compressed, and
    Spark knows how large the result is when it chooses a join.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; UDFs there import it."""
    context = spark.sparkContext
    if getattr(context, "_sectorpulse_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver serves the file for as long as the application runs.
    folder = tempfile.mkdtemp(prefix="sectorpulse-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "sectorpulse.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sectorpulse_shipped = True
