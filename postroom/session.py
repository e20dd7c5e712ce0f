"""Session settings the mail operators rely on."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results, not only speed.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Rows and bytes in an Arrow batch: whole texts travel in them, so a batch of long ones must still be small.
#: A worker that decodes mail holds a batch several times over, and an executor has up to two workers a core.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
ROWS_SETTING, BYTES_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def pin(spark: SparkSession) -> SparkSession:
    """Apply ``PINNED`` to a running session and return it."""
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postroom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_postroom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "postroom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, f"postroom/{source.relative_to(root)}")
        kept = Path(tempfile.mkdtemp(prefix="postroom-")) / "postroom.zip"
        shutil.move(path, kept)
    context.addPyFile(str(kept))
    context._postroom_shipped = True


def arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound what one Arrow batch carries to a Python worker, and see that workers have this package.

    The bounds stay: frames that are made under them may run much later.
    """
    ship(spark)
    spark.conf.set(ROWS_SETTING, str(ARROW_ROWS))
    spark.conf.set(BYTES_SETTING, str(size))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, its lineage cut; a local session that names none gets one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postroom-"))
    return df.checkpoint()
