"""Mail files as they arrive in a folder: a stateless stream of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decoded
from ..sources.files import GLOBS

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, kind: str, table: str, most_files: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", GLOBS[kind]).option("maxFilesPerTrigger", most_files).load(folder)
    return decoded(files.select(F.col("path").alias("file_id"), "content"), kind, table)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to a Parquet table; each file counts once across restarts."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
