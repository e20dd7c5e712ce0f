"""Mail files as tables: batch readers over any folder Spark can read, and writers.

Readers pass ``tags`` and ``substitution`` on to ``decoded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import decoded

GLOBS = {"msg": "*.msg", "eml": "*.eml", "pst": "*.pst"}


def scan(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """``file_id`` (the path), ``length`` and ``content`` of each file, whole files only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("file_id"), "length", "content")


def read_msg(spark: SparkSession, path: str, table: str = "messages", pattern: str = GLOBS["msg"], strict_errors: bool = False, **tables) -> DataFrame:
    return decoded(scan(spark, path, pattern), "msg", table, strict_errors, **tables)


def read_eml(spark: SparkSession, path: str, table: str = "mime_parts", pattern: str = GLOBS["eml"], strict_errors: bool = False, **tables) -> DataFrame:
    return decoded(scan(spark, path, pattern), "eml", table, strict_errors, **tables)


def read_pst(spark: SparkSession, path: str, table: str = "pst_items", pattern: str = GLOBS["pst"], strict_errors: bool = False, **tables) -> DataFrame:
    return decoded(scan(spark, path, pattern), "pst", table, strict_errors, **tables)


def _parse(files: DataFrame, id_col: str, content_col: str, kind: str, table: str, **tables) -> DataFrame:
    return decoded(files.select(F.col(id_col).alias("file_id"), F.col(content_col).alias("content")), kind, table, **tables)


def parse_eml(texts: DataFrame, id_col: str, text_col: str, table: str = "mime_parts", **tables) -> DataFrame:
    """The same tables from a column of raw messages."""
    return _parse(texts, id_col, text_col, "eml", table, **tables)


def parse_msg(files: DataFrame, id_col: str, content_col: str, table: str = "messages", **tables) -> DataFrame:
    """The same from a column of compound files' bytes."""
    return _parse(files, id_col, content_col, "msg", table, **tables)


def parse_pst(files: DataFrame, id_col: str, content_col: str, table: str = "pst_items", **tables) -> DataFrame:
    """The same from a column of stores' bytes."""
    return _parse(files, id_col, content_col, "pst", table, **tables)


def all_warnings(spark: SparkSession, path: str, **tables) -> DataFrame:
    """Warnings of all mail files below ``path``, by extension; files that can't be read are ``parse_error`` rows."""
    out = None
    for kind, pattern in GLOBS.items():
        one = decoded(scan(spark, path, pattern), kind, "warnings", **tables).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def write_eml(mails: DataFrame, path: str) -> None:
    """``file_id, eml`` as JSON lines, one message a line, sorted within files."""
    mails.select("file_id", "eml").sortWithinPartitions("file_id").write.mode("errorifexists").json(path)


def write_snapshot(metrics: DataFrame, path: str, key: str = "file_id") -> None:
    """A small table of metrics as one sorted JSON file."""
    metrics.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").json(path)
