"""Further queries over written containers: RTF, named properties, embedded messages, associations, headers, mail gates.

The catalogue registers them with its own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import dims, rtf
from ..operators import gates, properties
from ..operators.decode import decoded
from ..session import ship
from ..sources import synthetic
from ..sources.files import parse_eml
from .catalogue import query, t

#: A substitution made by rule: every byte once.
SUBSTITUTION = bytes((0x47 + 77 * k) % 256 for k in range(256))


def _written(df: DataFrame, make: Callable[..., bytes], *columns: str) -> DataFrame:
    """``file_id, content``: a container for each row of ``df``, from its ``columns``."""
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def write(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([make(*r) for r in rows.itertuples(index=False)])

    return df.select("file_id", write(F.struct(*columns)).alias("content"))


def _rtf_text(content: bytes) -> str:
    return rtf.to_text(rtf.decompress(content)).decode("utf-8")


def _rtf_html(content: bytes) -> str:
    return (rtf.to_html(rtf.decompress(content)) or b"").decode("utf-8")


def _read(files: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    @F.pandas_udf("string")
    def rows(content: pd.Series) -> pd.Series:
        return pd.Series([read(x) for x in content])

    return files.select("file_id", rows("content").alias("text"))


@query("SELECT c_custkey AS file_id, c_name || chr(10) || c_mktsegment || ' - ' || c_nationkey || chr(9) || '{x\\y}' AS text FROM customer")
def rtf_packed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed RTF of each customer, with a group to leave out, escapes and control words, back to text."""
    make = lambda name, segment, nation: synthetic.packed_rtf(
        rf"{{\rtf1\ansi{{\*\generator a {{b}};}}\b {name}\b0 \par {segment} \endash  {nation}\tab \{{x\\y\}}}}".encode()
    )
    d = t(spark, sf_dir, "customer").withColumn("file_id", F.col("c_custkey"))
    return _read(_written(d, make, "c_name", "c_mktsegment", "c_nationkey"), _rtf_text)


@query("SELECT doc_id AS file_id, sha256('<p>' || replace(text, chr(10), chr(13) || chr(10)) || '</p>') AS sha FROM documents WHERE text IS NOT NULL AND strpos(text, chr(13)) = 0 AND strpos(text, chr(9)) = 0")
def rtf_wrapped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML of each whole document wrapped in RTF, unwrapped again."""

    def make(text: str) -> bytes:
        safe = text.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}").replace("\n", "\\par ")
        raw = (r"{\rtf1\ansi\fromhtml1 {\*\htmltag64 <p>}\htmlrtf hidden\htmlrtf0 " + safe + r"{\*\htmltag72 </p>}}").encode()
        return struct.pack("<4I", len(raw) + 12, len(raw), rtf.PLAIN, 0) + raw

    d = t(spark, sf_dir, "documents").withColumn("file_id", F.col("doc_id")).filter("text IS NOT NULL AND NOT contains(text, '\\r') AND NOT contains(text, '\\t')")
    return _read(_written(d, make, "text"), _rtf_html).select("file_id", F.sha2("text", 256).alias("sha"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").withColumn("file_id", F.col("n_nationkey"))


@query("SELECT n_nationkey AS file_id, 32768 AS pseudo_code, 32773 AS code, CAST(NULL AS VARCHAR) AS named, 'file_under' AS name FROM nation UNION ALL SELECT n_nationkey, 32769, NULL, n_name, NULL FROM nation")
def msg_named_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered and a worded named property in each message."""

    def make(name: str) -> bytes:
        word = name.encode("utf-16-le")
        entries = struct.pack("<IIII", 0x8005, 2 << 1, 0, 1 << 1 | 1)
        names = {"__substg1.0_00020102": dims.SETS["psetid_address"], "__substg1.0_00030102": entries, "__substg1.0_00040102": struct.pack("<I", len(word)) + word}
        return synthetic.msg_file({0x0037: name}, names=names)

    out = decoded(_written(_nations(spark, sf_dir), make, "n_name"), "msg", "named_map", strict_errors=True)
    return out.toDF("file_id", "pseudo_code", "code", "named", "guid", "name").drop("guid")


@query("SELECT n_nationkey AS file_id, n_name AS subject, 1 AS n_attachments FROM nation UNION ALL SELECT n_nationkey, 'inside ' || n_regionkey, 0 FROM nation")
def msg_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages within messages, each a row."""
    make = lambda name, region: synthetic.msg_file(
        {0x0037: name}, [], [{0x3705: 5, "msg": synthetic.message_tree({0x0037: f"inside {region}"})}]
    )
    out = decoded(_written(_nations(spark, sf_dir), make, "n_name", "n_regionkey"), "msg", "messages", strict_errors=True)
    return out.select("file_id", "subject", "n_attachments")


def _stores(spark: SparkSession, sf_dir: str, substitution: bytes | None) -> DataFrame:
    """A store for each region: its nations as messages in one folder."""
    n = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("own"))

    def make(own) -> bytes:  # noqa: ANN001
        items = [(1000 + int(r["n_nationkey"]), 0x21, {0x001A: "IPM.Note", 0x0037: r["n_name"]}) for r in own]
        return synthetic.store_file([(0x21, 0, {0x3602: 1, 0x3001: "Top"}), *items], substitution)

    return _written(n, make, "own")


@query("SELECT n_regionkey AS file_id, 1000 + n_nationkey AS item, n_name AS subject FROM nation")
def pst_encoded_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of stores whose blocks are encoded, read with their substitution."""
    out = decoded(_stores(spark, sf_dir, SUBSTITUTION), "pst", "pst_items", strict_errors=True, substitution=SUBSTITUTION)
    return out.filter("type = 'message'").select("file_id", F.col(out.columns[1]).cast("long").alias("item"), "subject")


@query("SELECT file_id, item, n FROM (SELECT n_regionkey AS file_id, 1000 + n_nationkey AS item, 2::BIGINT AS n FROM nation UNION ALL SELECT r_regionkey, 33, 1 FROM region)")
def pst_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each item has outside its own block."""
    out = decoded(_stores(spark, sf_dir, None), "pst", "pst_id2", strict_errors=True)
    return out.groupBy("file_id", F.col(out.columns[1]).cast("long").alias("item")).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS file_id, 1 + count(*) AS items, 1::BIGINT AS folders, count(*) AS messages FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def pst_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.store_probe(decoded(_stores(spark, sf_dir, None), "pst", "pst_items", strict_errors=True))


@query(
    "SELECT conv_id, turn, 'X-Role: ' || role || '; Subject: ' || role || '; To: second' AS edited FROM conversations"
)
def header_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first header of a name replaced, and one added behind the others."""
    head = F.concat(F.lit("X-Role: old\r\nSubject: "), F.col("role"))
    d = t(spark, sf_dir, "conversations").withColumn("h", c.parse_headers(head))
    d = d.withColumn("h", c.add_header(c.set_header("h", "X-Role", F.col("role")), "To", F.lit("second")))
    return d.select("conv_id", "turn", F.array_join(F.transform("h", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "; ").alias("edited"))


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of each turn of the conversations that has a text without lines of its own."""
    v = t(spark, sf_dir, "conversations").filter("text IS NOT NULL AND NOT contains(text, '\\n') AND NOT contains(text, '\\r')")
    key = F.concat_ws("-", "conv_id", "turn")
    raw = F.concat(F.lit("From: A <"), "role", F.lit("@Example.org>\r\nTo: b@example.org, C <c@example.org>\r\nSubject: "), "role", F.lit("\r\n\r\n"), "text")
    return v.select(key.alias("file_id"), raw.alias("eml"), "role", "text")


@query(
    "SELECT conv_id || '-' || turn AS file_id, role AS subject, lower(role) || '@example.org' AS sender, 'b@example.org,c@example.org' AS receivers, octet_length(encode(text)) AS body_len "
    "FROM conversations WHERE text IS NOT NULL AND strpos(text, chr(10)) = 0 AND strpos(text, chr(13)) = 0"
)
def eml_harness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.eml_rows(parse_eml(_mails(spark, sf_dir), "file_id", "eml"))


@query(
    "WITH m AS (SELECT conv_id || '-' || turn AS file_id, role, text, octet_length(encode(text)) AS n FROM conversations WHERE text IS NOT NULL AND strpos(text, chr(10)) = 0 AND strpos(text, chr(13)) = 0) "
    "SELECT file_id, 'subject' AS failure FROM m WHERE turn_of(file_id) % 3 = 0 UNION ALL SELECT file_id, 'body_len' FROM m WHERE n + 100 - n > greatest(64, floor((n + 100) * 0.2))".replace("turn_of(file_id)", "CAST(split_part(file_id, '-', -1) AS BIGINT)")
)
def eml_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of our parser against rows that differ in every third subject and by 100 octets of body."""
    ours = gates.eml_rows(parse_eml(_mails(spark, sf_dir), "file_id", "eml"))
    turn = F.element_at(F.split("file_id", "-"), -1).cast("long")
    theirs = ours.withColumn("subject", F.when(turn % 3 == 0, F.lit("other")).otherwise(F.col("subject"))).withColumn("body_len", F.col("body_len") + 100)
    return gates.eml_failures(ours, theirs, "file_id", ["subject", "sender", "receivers"])


@query(
    "SELECT conv_id || '-' || turn AS file_id, 'subject' AS field, role AS ours, 'other' AS theirs FROM conversations WHERE text IS NOT NULL AND strpos(text, chr(10)) = 0 AND strpos(text, chr(13)) = 0 AND turn % 3 = 0"
)
def eml_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = gates.eml_rows(parse_eml(_mails(spark, sf_dir), "file_id", "eml"))
    turn = F.element_at(F.split("file_id", "-"), -1).cast("long")
    theirs = ours.withColumn("subject", F.when(turn % 3 == 0, F.lit("other")).otherwise(F.col("subject")))
    out = gates.field_diff(ours, theirs, "file_id", ["subject", "sender", "receivers"])
    return out.withColumnsRenamed({"left": "ours", "right": "theirs"})


# Counts of the published list by kind, stated apart from ``dims``.
@query("SELECT * FROM (VALUES ('pt_binary', 74), ('pt_boolean', 22), ('pt_long', 43), ('pt_object', 2), ('pt_systime', 14), ('pt_tstring', 126), ('none', 65536 - 281)) AS v(kind, n)")
def published_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every code of 16 bits, by kind, with the whole published list."""
    codes = spark.range(0, 1 << 16).select(F.col("id").cast("int").alias("code"))
    out = codes.join(F.broadcast(properties.dim_tags(spark, dims.PUBLISHED)), "code", "left")
    return out.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))
