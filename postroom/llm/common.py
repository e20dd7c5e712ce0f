"""What the corpus operators share: table reads, shared scratch space, batch size."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import ARROW_ROWS, BYTES_SETTING, ROWS_SETTING, ship  # noqa: F401 - operators take them from here

#: Bytes in an Arrow batch here, where a worker holds few copies of it.
ARROW_BYTES = 16 << 20
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    session.arrow_batches(spark, ARROW_BYTES)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set for what runs inside, and as before after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none and is local itself (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="postroom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage; Spark removes it when unused."""
    shared_folder(df.sparkSession)
    with setting(df.sparkSession, CLEANUP_SETTING, "true"):
        return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder for the time of one computation.

    ``keep(df)`` writes and rereads, and Spark deletes the shuffle files of the write when
    it has ended; ``close()`` deletes everything written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(shared_folder(spark), f"scratch-{uuid.uuid4().hex}")
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with setting(self.spark, CLEANUP_SETTING, "true"):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, upto: int | None = None) -> None:
        """Delete table ``upto`` (or all)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root if upto is None else f"{self.root}/{upto}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop()
