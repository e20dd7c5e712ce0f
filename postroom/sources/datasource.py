"""Python data sources ``mail_eml``, ``mail_msg`` and ``mail_pst``.

``spark.read.format("mail_msg").option("table", "recipients").load(folder)`` for folders
that every executor can open as files; ``sources.files`` reads everything else. Option
``tags`` has lines of code, name and kind, option ``substitution`` 512 hexadecimal digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..functions import dims
from ..operators.decode import DECODERS, SCHEMAS
from .files import GLOBS


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MailReader(DataSourceReader):
    def __init__(self, kind: str, table: str, path: str, tags: str = "", substitution: str = ""):
        self.kind, self.table, self.path, self.only = kind, table, path, None
        self.tags, self.substitution = dims.entries(tags), bytes.fromhex(substitution) or None

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        """An equality on file_id picks its file before any is opened."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file_id",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path)
        found = [root] if root.is_file() else sorted(root.rglob(GLOBS[self.kind]))
        return [OneFile(str(p)) for p in found if self.only in (None, str(p))] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition.path:
            dims.use(self.tags, self.substitution)
            try:
                rows = list(DECODERS[self.kind, self.table](Path(partition.path).read_bytes()))
            except Exception:  # noqa: BLE001 - the ``warnings`` table says why
                rows = []
            yield from ((partition.path, *row) for row in rows)


class _Mail(DataSource):
    kind, default = "", ""

    @classmethod
    def name(cls) -> str:
        return f"mail_{cls.kind}"

    @property
    def table(self) -> str:
        return self.options.get("table", self.default)

    def schema(self) -> str:
        return f"file_id string, {SCHEMAS[self.table]}"

    def reader(self, schema) -> MailReader:
        return MailReader(self.kind, self.table, self.options["path"], self.options.get("tags", ""), self.options.get("substitution", ""))


class EmlSource(_Mail):
    kind, default = "eml", "mime_parts"


class MsgSource(_Mail):
    kind, default = "msg", "messages"


class PstSource(_Mail):
    kind, default = "pst", "pst_items"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with their filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EmlSource, MsgSource, PstSource):
        spark.dataSource.register(source)
