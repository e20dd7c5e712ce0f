"""Registered mail queries and their SQL twins.

The tables of the test data stand in for mail: documents are bodies, conversations are
recipient lists, keys and prices are property values, customers of nations of regions are
folders. Each query takes (spark, folder) and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import dims
from ..operators import convert, gates, hierarchy, properties
from ..operators.decode import decoded
from ..session import pin
from ..sources import synthetic
from ..sources.files import parse_eml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(pin(spark), sf_dir)

        QUERIES[f.__name__] = pinned
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    raw = F.concat(F.lit("From: corpus@example.org\r\nSubject: "), "source", F.lit("\r\nX-Lang: "), "lang", F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "text")
    return d.select("doc_id", "lang", "source", raw.alias("raw"))


# -- MIME


@query("SELECT lang, count(*) AS mails, sum(octet_length(encode(text)))::BIGINT AS body_bytes, 0::BIGINT AS multiparts FROM documents GROUP BY lang")
def eml_parse_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parse_eml(documents_as_mail(spark, sf_dir), "doc_id", "raw")
    return parts.groupBy(c.get_header("headers", "x-lang").alias("lang")).agg(
        F.count("*").alias("mails"), F.sum(F.octet_length("body")).alias("body_bytes"), F.count_if("multipart").alias("multiparts")
    )


@query("SELECT lang, count(*) AS mails, sum(octet_length(encode(text)))::BIGINT AS body_bytes, min(lower('text/plain')) AS main_type, min('utf-8') AS charset FROM documents GROUP BY lang")
def eml_parse_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = documents_as_mail(spark, sf_dir).select(c.split_message("raw").alias("m")).select(c.parse_headers("m.head").alias("h"), F.col("m.body").alias("body"))
    ct = c.get_header("h", "Content-Type")
    return m.groupBy(c.get_header("h", "X-LANG").alias("lang")).agg(
        F.count("*").alias("mails"), F.sum(F.octet_length("body")).alias("body_bytes"), F.min(c.main_value(ct)).alias("main_type"), F.min(F.try_element_at(c.params(ct), F.lit("charset"))).alias("charset")
    )


@query("SELECT doc_id, source AS subject, sha256(text) AS body_sha256 FROM documents")
def eml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = parse_eml(parse_eml(documents_as_mail(spark, sf_dir), "doc_id", "raw", "eml"), "file_id", "eml")
    return again.select(F.col("file_id").alias("doc_id"), c.get_header("headers", "subject").alias("subject"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


_PAIRS = "FROM (SELECT coalesce(doc_id, page_id) AS doc_id, coalesce(text, '') AS text, coalesce(html, '') AS html FROM documents FULL JOIN pages ON doc_id = page_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "pages"), F.col("doc_id") == F.col("page_id"), "full_outer")
    return both.select(F.coalesce("doc_id", "page_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("html", F.lit("")).alias("html"))


@query(
    f"SELECT doc_id, 0 AS ord, 'text/plain' AS content_type, octet_length(encode(text)) + 2 AS n_bytes {_PAIRS} "
    f"UNION ALL SELECT doc_id, 1 AS ord, 'text/html' AS content_type, octet_length(encode(html)) + 2 AS n_bytes {_PAIRS}"
)
def mime_multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pairs(spark, sf_dir)
    b = "=_edge_of_parts_="
    raw = F.concat(
        F.lit(f'Content-Type: multipart/alternative; boundary="{b}"\r\n\r\nFor readers without MIME.\r\n--{b}\r\nContent-Type: text/plain\r\n\r\n'), "text",
        F.lit(f"\r\n--{b}\r\nContent-Type: text/html\r\n\r\n"), "html", F.lit(f"\r\n--{b}--\r\n"),
    )
    parts = parse_eml(both.select("doc_id", raw.alias("raw")), "doc_id", "raw").filter(F.size("part_path") == 1)
    return parts.select(F.col("file_id").alias("doc_id"), "ord", "content_type", F.octet_length("body").alias("n_bytes"))


@query(
    f"SELECT doc_id, 2::BIGINT AS n_parts, octet_length(encode(text)) + octet_length(encode(html)) + 4 + length('Content-Type: text/plain') + length('Content-Type: text/html') + 8 AS n_bytes {_PAIRS}"
)
def mime_split_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pairs(spark, sf_dir)
    b = "=_edge_of_parts_="
    body = F.concat(F.lit(f"preamble\r\n--{b}\r\nContent-Type: text/plain\r\n\r\n"), "text", F.lit(f"\r\n--{b}\r\nContent-Type: text/html\r\n\r\n"), "html", F.lit(f"\r\n--{b}--\r\n"))
    parts = c.split_parts(body, F.lit(b))
    size = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return both.select("doc_id", F.size(parts).cast("long").alias("n_parts"), size.alias("n_bytes"))


_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_SPACE}', '', 'g')) AS letters_sha256 FROM documents")
def header_fold_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as subjects, folded and unfolded: white space may move, nothing else."""
    raw = F.concat(F.lit("Subject: "), F.regexp_replace("text", f"{_SPACE}+", " "), F.lit("\r\n\r\n"))
    folded = parse_eml(t(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw", "eml")
    back = parse_eml(folded, "file_id", "eml")
    letters = F.regexp_replace(c.get_header("headers", "Subject"), _SPACE, "")
    return back.select(F.col("file_id").alias("doc_id"), F.sha2(letters.cast("binary"), 256).alias("letters_sha256"))


@query("SELECT doc_id, CASE WHEN length(text) < octet_length(encode(text)) THEN '=?UTF-8?B?' || to_base64(encode(text)) || '?=' ELSE text END AS encoded, text AS decoded FROM documents")
def rfc2047_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", c.encode_header("text").alias("encoded"))
    return d.select("doc_id", "encoded", c.decode_base64_word("encoded").alias("decoded"))


@query(
    "SELECT doc_id, octet_length(encode(s)) * 3 - 2 * length(regexp_replace(s, '[^\\t\\r\\n -<>-~]', '', 'g')) AS qp_len FROM (SELECT doc_id, text AS s FROM documents)"
)
def qp_body_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.length(c.quoted_printable_units("text")).cast("long").alias("qp_len"))


@query("SELECT doc_id, (length(to_base64(encode(text))) + 75) // 76 AS n_lines, length(to_base64(encode(text))) AS n_chars FROM documents")
def b64_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(c.base64_lines(F.encode("text", "UTF-8")), "\r\n")
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("text") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars")
    )


@query("SELECT lang, CASE WHEN length(text) = octet_length(encode(text)) THEN '7bit' ELSE 'quoted-printable' END AS encoding, count(*) AS n FROM documents GROUP BY 1, 2")
def transfer_encoding_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy("lang", c.transfer_encoding("text").alias("encoding")).agg(F.count("*").alias("n"))


# -- recipients and headers

_ROLE = {"user": 1, "assistant": 2, "system": 0}


def _recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(0)
    name = F.when(F.col("turn") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("R"), "turn"))
    email = F.concat("role", F.lit("-"), "turn", F.lit("@example.org"))
    return t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), c.recipient_type(code).alias("type"), name.alias("name"), email.alias("email"))


@query("SELECT CASE role WHEN 'user' THEN 'to' WHEN 'assistant' THEN 'cc' ELSE 'orig' END AS type, count(*) AS n FROM conversations GROUP BY 1")
def recipients_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipients(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


_ADDRESS = "CASE WHEN turn % 3 = 0 THEN '<' || role || '-' || turn || '@example.org>' ELSE '\"R' || turn || '\" <' || role || '-' || turn || '@example.org>' END"


@query(
    f"SELECT conv_id, string_agg({_ADDRESS}, ', ' ORDER BY turn, {_ADDRESS}) FILTER (WHERE role = 'user') AS to_header, string_agg({_ADDRESS}, ', ' ORDER BY turn, {_ADDRESS}) FILTER (WHERE role = 'assistant') AS cc_header FROM conversations GROUP BY conv_id"
)
def recipient_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.recipient_lists(_recipients(spark, sf_dir), ["conv_id"]).drop("bcc_header")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@smtp' WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '@rep' WHEN c_nationkey % 5 = 0 THEN c_mktsegment || '@alt' ELSE c_name || '@smtp' END AS sender FROM customer"
)
def sender_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "smtp").otherwise("EX")
    rep = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit("@rep")))
    alt = F.when(F.col("c_nationkey") % 5 == 0, F.concat("c_mktsegment", F.lit("@alt")))
    return t(spark, sf_dir, "customer").select("c_custkey", c.sender(kind, F.concat("c_name", F.lit("@smtp")), rep, alt).alias("sender"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' END AS importance, CASE p_partkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '3' WHEN 2 THEN '1' END AS x_priority, "
    "CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'personal' WHEN 2 THEN 'private' WHEN 3 THEN 'confidential' END AS sensitivity, CASE p_size % 5 WHEN 1 THEN 'Personal' WHEN 2 THEN 'Private' WHEN 3 THEN 'Company-Confidential' END AS sensitivity_header FROM part"
)
def importance_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_partkey") % 4, F.col("p_size") % 5
    return t(spark, sf_dir, "part").select("p_partkey", c.importance(a).alias("importance"), c.x_priority(a).alias("x_priority"), c.sensitivity(b).alias("sensitivity"), c.sensitivity_header(b).alias("sensitivity_header"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def filetime_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) + 11644473600000000) * 10
    return t(spark, sf_dir, "events").withColumn("ticks", ticks).select("event_id", F.unix_micros(c.filetime("ticks")).alias("micros"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS date_header FROM events")
def rfc2822_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", c.rfc2822(F.col("ts").cast("timestamp")).alias("date_header"))


@query(
    "SELECT o_orderkey, o_orderstatus AS subject, '\"Customer ' || o_custkey || '\" <c' || o_custkey || '@example.org>' AS sender, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS date_header, "
    "5 + CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 1 ELSE 0 END + CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END AS n_headers FROM orders"
)
def message_header_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    level = F.when(F.startswith("o_orderpriority", F.lit("1")), 2).when(F.startswith("o_orderpriority", F.lit("2")), 1).when(F.startswith("o_orderpriority", F.lit("3")), 0)
    m = {
        "sender_name": F.concat(F.lit("Customer "), "o_custkey"), "sender_email": F.concat(F.lit("c"), "o_custkey", F.lit("@example.org")), "to": F.lit("<a@example.org>"), "cc": none, "bcc": none,
        "subject": F.col("o_orderstatus"), "date": F.col("o_orderdate").cast("timestamp"), "message_id": none, "in_reply_to": none, "references": none, "importance": level, "sensitivity": F.lit(0),
    }
    h = t(spark, sf_dir, "orders").select("o_orderkey", convert.message_headers(m).alias("h"))
    return h.select("o_orderkey", c.get_header("h", "subject").alias("subject"), c.get_header("h", "from").alias("sender"), c.get_header("h", "date").alias("date_header"), F.size("h").alias("n_headers"))


# -- typed values and keys


@query("SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS sum_long, sum(l_linenumber)::BIGINT AS sum_short, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS n_true FROM lineitem GROUP BY 1")
def prop_decode_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.concat(c.le_hex("l_orderkey", 4), c.le_hex("l_linenumber", 2), c.le_hex(F.col("l_linenumber") % 2, 2)))
    p = t(spark, sf_dir, "lineitem").select("l_returnflag", raw.alias("raw"))
    return p.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum(c.le_int32("raw")).alias("sum_long"), F.sum(c.le_uint("raw", 4, 2)).alias("sum_short"), F.count_if(c.le_uint("raw", 6, 2) != 0).alias("n_true")
    )


_HEX = "upper(md5(c_name))"


@query(
    f"SELECT c_custkey, '{{' || h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] || '}}' AS guid, h AS raw_hex FROM (SELECT c_custkey, {_HEX} AS h FROM customer)"
)
def guid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "customer").select("c_custkey", c.guid_text(F.unhex(F.md5(F.col("c_name").cast("binary")))).alias("guid"))
    return g.select("c_custkey", "guid", F.hex(c.guid_bytes("guid")).alias("raw_hex"))


def _part_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    pairs = F.array(
        F.struct(F.lit(0x0037).alias("code"), F.col("p_name").alias("value")), F.struct(F.lit(0x5909).alias("code"), F.concat("p_brand", F.lit("@high")).alias("value")),
        F.struct(F.lit(0x39FE).alias("code"), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("@low"))).alias("value")), F.struct(F.lit(0x0017).alias("code"), F.col("p_size").cast("string").alias("value")),
    )
    return p.select("p_partkey", F.explode(pairs).alias("p")).select("p_partkey", "p.code", "p.value")


@query("SELECT p_partkey, p_name AS subject, CASE WHEN p_size % 2 = 0 THEN p_brand || '@low' ELSE p_brand || '@high' END AS email, CAST(p_size AS VARCHAR) AS importance FROM part")
def props_pivot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.wide(_part_props(spark, sf_dir), ["p_partkey"], {"subject": "pr_subject", "email": "pr_smtp_address", "importance": "pr_importance"})


@query("SELECT s_suppkey, true AS value FROM supplier WHERE s_suppkey % 2 = 0")
def props_false_is_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.lit(dims.TAG_CODES["pr_subfolders"]).alias("code"), (F.col("s_suppkey") % 2 == 0).alias("value"))
    return properties.get(rows, ["s_suppkey"], "pr_subfolders", boolean=True)


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows) + f") AS v({names})"


@query(
    "SELECT coalesce(v.kind, 'none') AS kind, count(*) AS n, sum(r.range)::BIGINT AS code_sum FROM range(0, 32768) r LEFT JOIN "
    + _values([(k, n, kind) for k, (n, kind) in dims.TAGS.items()], "code, name, kind") + " ON r.range = v.code GROUP BY 1"
)
def tag_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(0, 32768).select(F.col("id").cast("int").alias("code"))
    out = codes.join(F.broadcast(properties.dim_tags(spark)), "code", "left")
    return out.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum("code").alias("code_sum"))


@query(
    "SELECT r.range AS code, coalesce(v.name, lpad(lower(printf('%x', r.range)), 4, '0')) AS key_text FROM range(0, 4096) r LEFT JOIN "
    + _values([(k, n) for k, (n, _) in dims.TAGS.items() if k < 4096], "code, name") + " ON r.range = v.code"
)
def key_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(0, 4096).select(F.col("id").alias("code"), F.lit(None).cast("binary").alias("guid"))
    return properties.with_names(codes).select("code", "key_text")


@query("SELECT code, label AS set_label, name FROM " + _values([(k, dims.SET_NAMES[g], n) for (k, g), n in dims.NAMED.items()], "code, label, name"))
def named_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(0, 1 << 16).select(F.col("id").cast("int").alias("code")).join(F.broadcast(properties.dim_named(spark)), "code")
    return every.join(F.broadcast(properties.dim_sets(spark)), "guid").select("code", F.col("label").alias("set_label"), "name")


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def mv_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("index"), F.col("l_partkey").alias("value"))
    return properties.multi_values(rows, ["l_orderkey"]).select("l_orderkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("parts"))


@query("SELECT o_orderkey AS id, coalesce(max(l_linenumber), -1)::BIGINT AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 UNION ALL SELECT l_orderkey, max(l_linenumber)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def inline_substg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(-1).cast("long").alias("value"))
    own = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").cast("long").alias("value"))
    return properties.merge_last_wins(inline, own, ["id"])


@query("SELECT o_orderkey, o_orderkey % 65536 AS code, o_custkey % 4096 + 4096 AS type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS idx FROM orders")
def substg_name_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    key, kind = F.col("o_orderkey") % 65536, F.col("o_custkey") % 4096 + 4096
    name = F.concat(F.lit("__substg1.0_"), h(key, 4), h(kind, 4), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), h(F.col("o_orderkey") % 7, 8))).otherwise(""))
    out = t(spark, sf_dir, "orders").select("o_orderkey", c.stream_key(name).alias("k"))
    return out.select("o_orderkey", F.col("k.code").cast("long").alias("code"), F.col("k.type").cast("long").alias("type"), F.col("k.index").cast("long").alias("idx"))


# -- hierarchies


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).alias("file_id")
    top = spark.range(1).select(one, F.lit(33).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ord"))
    row = lambda df, key, parent: df.select(one, key.cast("long").alias("id"), parent.cast("long").alias("parent_id"), key.cast("long").alias("ord"))
    r = row(t(spark, sf_dir, "region"), F.col("r_regionkey") + 100, F.lit(33))
    n = row(t(spark, sf_dir, "nation"), F.col("n_nationkey") + 1000, F.col("n_regionkey") + 100)
    k = row(t(spark, sf_dir, "customer"), F.col("c_custkey") + 100000, F.col("c_nationkey") + 1000)
    return top.unionByName(r).unionByName(n).unionByName(k)


_TREE = (
    "WITH RECURSIVE f AS (SELECT 33::BIGINT AS id, 0::BIGINT AS parent_id UNION ALL SELECT r_regionkey + 100, 33 FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100 FROM nation "
    "UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000 FROM customer), w AS (SELECT id, parent_id, 0 AS depth FROM f WHERE id = 33 UNION ALL SELECT f.id, f.parent_id, w.depth + 1 FROM w JOIN f ON f.parent_id = w.id) "
)


@query(_TREE + "SELECT depth, count(*) AS n, sum(id)::BIGINT AS id_sum FROM w GROUP BY depth")
def pst_hierarchy_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.walk(_folders(spark, sf_dir), 33).groupBy("depth").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query(_TREE + "SELECT parent_id, count(*) AS n_children, min(id) AS first_child FROM w WHERE parent_id <> 0 GROUP BY 1")
def pst_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = hierarchy.children(_folders(spark, sf_dir))
    return kids.select("parent_id", F.size("children").cast("long").alias("n_children"), F.element_at("children", 1).alias("first_child"))


@query("WITH RECURSIVE w AS (SELECT s_suppkey AS start, s_suppkey AS id, 0 AS hop FROM supplier WHERE s_suppkey <= 10 UNION ALL SELECT w.start, w.id + 10, w.hop + 1 FROM w WHERE w.id + 10 <= (SELECT max(s_suppkey) FROM supplier)) SELECT start, count(*) AS sectors, max(id) AS last_sector FROM w GROUP BY 1")
def fat_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    top = s.agg(F.max("id").alias("top"))
    links = s.join(F.broadcast(top)).select("id", F.when(F.col("id") + 10 <= F.col("top"), F.col("id") + 10).alias("next"))  # one row beside each
    out = hierarchy.chain(links, s.filter("id <= 10").select(F.col("id").alias("start")))
    return out.groupBy("start").agg(F.count("*").alias("sectors"), F.max("id").alias("last_sector"))


_CLASSES = ["IPM.Note", "IPM.Post.x", "IPM.Appointment", "ipm.contact", "IPM.Task", "IPM.StickyNote", "IPM.Activity", "REPORT.IPM", None]


@query(
    "SELECT type, count(*) AS n FROM (SELECT CASE event_id % 9 WHEN 2 THEN 'appointment' WHEN 3 THEN 'contact' WHEN 4 THEN 'task' WHEN 5 THEN 'note' WHEN 6 THEN 'journal' "
    "WHEN 8 THEN CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN 'folder' ELSE 'message' END ELSE 'message' END AS type FROM events) GROUP BY 1"
)
def pst_detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x).cast("string") for x in _CLASSES))
    kind = F.element_at(names, (F.col("event_id") % 9 + 1).cast("int"))
    count = F.when(F.col("user_id") % 2 == 0, 1)
    return t(spark, sf_dir, "events").groupBy(c.item_type(kind, count, F.col("user_id") % 3 == 0).alias("type")).agg(F.count("*").alias("n"))


# -- attachments

_EXT = ["pdf", "TXT", "jpeg", "docx", "bin", ""]


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS media_type FROM part"
)
def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", c.media_type(F.concat(F.lit("file"), "p_partkey", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))).alias("media_type"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS n_inline, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS n_regular, bool_or(l_linenumber % 3 = 0) AS related FROM lineitem GROUP BY 1")
def attachment_inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.when(F.col("l_linenumber") % 3 == 0, F.lit("cid"))
    a = t(spark, sf_dir, "lineitem").select("l_orderkey", cid.isNotNull().alias("is_inline"))
    return convert.attachment_layout(a, ["l_orderkey"]).drop("outer_type")


# -- warnings and gates


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("file_id"), F.concat(F.lit("code_"), "event_type").alias("code"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("warn").alias("severity"),
        F.concat(F.lit("event "), "event_id").alias("message"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("user "), "user_id")).alias("context"), (F.col("event_id") % 11 != 0).alias("recoverable"), "event_id", "event_type",
    )


@query("SELECT event_id, '[' || CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'warn' END || ':code_' || event_type || '] ' || CASE WHEN event_id % 2 = 0 THEN 'user ' || user_id || ': ' ELSE '' END || 'event ' || event_id AS line FROM events")
def warning_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warnings(spark, sf_dir).select("event_id", c.format_warning("code", "severity", "message", "context").alias("line"))


@query(
    "WITH e AS (SELECT user_id AS file_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown_code' WHEN event_id % 7 = 0 THEN 'severity' WHEN event_id % 11 = 0 THEN 'unrecoverable' END AS reason FROM events) "
    "SELECT file_id, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT file_id, 'too_many', count(*) FROM e GROUP BY 1 HAVING count(*) > 12"
)
def warning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.warning_gate(_warnings(spark, sf_dir), ["code_view", "code_click"], ["error"], most=12)


@query("SELECT user_id AS file_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes, CASE WHEN count(DISTINCT event_type) > 3 THEN 'too_many' ELSE '' END AS failures FROM events GROUP BY 1")
def pst_code_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _warnings(spark, sf_dir).withColumn("code", F.col("event_type"))
    none = spark.createDataFrame([], "file_id bigint, expected array<string>")
    out = gates.store_gate(w, none, most=3)
    return out.select("file_id", F.array_join("codes", ",").alias("codes"), F.array_join("failures", ",").alias("failures"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), "lang", "source", F.col("n_chars").alias("body_len"), F.octet_length("text").cast("long").alias("octets"))


@query(
    "WITH m AS (SELECT coalesce(doc_id, page_id) AS file_id, doc_id, page_id, lang, n_chars AS b, octet_length(encode(html)) AS o FROM documents FULL JOIN pages ON doc_id = page_id) "
    "SELECT file_id, 'missing_row' AS field, 'high' AS severity FROM m WHERE page_id IS NULL UNION ALL SELECT file_id, 'extra_row', 'high' FROM m WHERE doc_id IS NULL "
    "UNION ALL SELECT file_id, 'lang', 'low' FROM m WHERE doc_id = page_id AND lang IS DISTINCT FROM 'en' "
    "UNION ALL SELECT file_id, 'body_len', 'medium' FROM m WHERE doc_id = page_id AND abs(b - o) > greatest(128, floor(b * 0.02))"
)
def baseline_diff_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against pages of the same number: rows on one side only, other languages, lengths out of tolerance."""
    pages = t(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("en").alias("lang"), F.octet_length("html").cast("long").alias("body_len"))
    return gates.baseline_diff(_metrics(spark, sf_dir), pages, "file_id", ["lang"], {"body_len": gates.BODY})


@query(
    "SELECT doc_id AS file_id, lang AS parser, source AS field FROM documents WHERE NOT (lang = 'en' OR source = 'src3' OR (lang = 'fr' AND source = 'src7'))"
)
def policy_allow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("parser"), F.col("source").alias("field"))
    rules = spark.createDataFrame([("en", None), (None, "src3"), ("fr", "src7")], "parser string, field string")
    return gates.violations(issues, rules, ["parser", "field"])


@query(
    "SELECT doc_id AS file_id, 'body_len' AS field, count(DISTINCT v) AS n_values, 'medium' AS severity FROM (SELECT doc_id, unnest([n_chars, octet_length(encode(text)), length(text)]) AS v FROM documents) GROUP BY 1 HAVING count(DISTINCT v) > 1"
)
def multi_parser_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang", "source", F.length("text").cast("long").alias("body_len"))
    rows = m.select("file_id", "lang", "source", "body_len", F.lit("a").alias("parser")).unionByName(m.select("file_id", "lang", "source", F.col("octets").alias("body_len"), F.lit("b").alias("parser")))
    return gates.compare_parsers(rows.unionByName(d.withColumn("parser", F.lit("c"))), ["lang", "source", "body_len"])


@query("SELECT doc_id AS file_id, 'body_len' AS failure FROM documents WHERE abs(n_chars - octet_length(encode(text))) > greatest(128, floor(n_chars * 0.02))")
def semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("html_len", F.lit(0).cast("long"))
    return gates.semantic_failures(m, m.withColumn("body_len", F.col("octets")), "file_id", ["lang", "source"])


@query(
    "SELECT conv_id, min(CASE WHEN turn = 0 THEN text END) IS NOT NULL AS has_first, count(*) AS recipient_count, arg_min(role || '@example.org', turn) AS first_recipient_email FROM conversations GROUP BY 1 HAVING count(*) = count(DISTINCT turn)"
)
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "conversations")
    r = v.select("conv_id", F.col("turn").alias("ord"), F.concat("role", F.lit("@example.org")).alias("email"))
    return (
        v.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).isNotNull().alias("has_first"), F.count("*").alias("recipient_count"), F.count_distinct("turn").alias("k"))
        .filter("recipient_count = k").drop("k").join(r.groupBy("conv_id").agg(F.min_by("email", "ord").alias("first_recipient_email")), "conv_id")
    )


@query(
    "SELECT doc_id, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS subject, 0::BIGINT AS recipient_count, 0::BIGINT AS attachment_count, octet_length(encode(text)) AS body_len, 0 AS html_len, sha256(text) AS body_sha256, sha256('') AS html_sha256 FROM documents"
)
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject"), F.col("text").alias("body"), F.lit(None).cast("string").alias("body_html"))
    none = spark.createDataFrame([], "doc_id bigint, ord int, email string")
    return gates.snapshot(m, none, none, ["doc_id"]).drop("first_recipient_email", "body_preview")


# -- binary containers, written from the tables and read back


def _msg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound file for each nation: its name as subject, its region as sender, an attachment."""
    from pyspark.sql.functions import pandas_udf

    from ..session import ship

    ship(spark)

    @pandas_udf("binary")
    def write(key, name, region):  # noqa: ANN001, ANN202
        make = lambda k, n, r: synthetic.msg_file(
            {0x0037: n, 0x0C1A: r, 0x0C1E: "SMTP", 0x0C1F: f"{r.lower().replace(' ', '.')}@example.org", 0x1000: f"Body of {n}", 0x0017: int(k) % 3, 0x0036: int(k) % 4},
            [{0x3001: n, 0x39FE: f"n{k}@example.org", 0x0C15: 1 + int(k) % 3}], [{0x3707: f"{n}.txt", 0x3701: n.encode(), 0x3705: 1}],
        )
        import pandas as pd

        return pd.Series([make(*x) for x in zip(key, name, region, strict=True)])

    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("file_id"), write("n_nationkey", "n_name", "r_name").alias("content"))


@query(
    "SELECT n_nationkey AS file_id, n_name AS subject, r_name AS sender_name, replace(lower(r_name), ' ', '.') || '@example.org' AS sender_email, 'Body of ' || n_name AS body, (n_nationkey % 3)::INTEGER AS importance, (n_nationkey % 4)::INTEGER AS sensitivity, 1 AS n_recipients, 1 AS n_attachments FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def msg_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decoded(_msg_files(spark, sf_dir), "msg", "messages", strict_errors=True)
    return m.select("file_id", "subject", "sender_name", "sender_email", "body", "importance", "sensitivity", "n_recipients", "n_attachments")


@query("SELECT n_nationkey AS file_id, n_name AS name, 'n' || n_nationkey || '@example.org' AS email, CASE n_nationkey % 3 WHEN 0 THEN 'to' WHEN 1 THEN 'cc' ELSE 'bcc' END AS type, '\"' || n_name || '\" <n' || n_nationkey || '@example.org>' AS address FROM nation")
def msg_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(_msg_files(spark, sf_dir), "msg", "recipients", strict_errors=True).drop("obj_path", "ord")


@query("SELECT n_nationkey AS file_id, n_name || '.txt' AS filename, 'text/plain' AS mime_type, octet_length(encode(n_name)) AS size, sha256(n_name) AS sha FROM nation")
def msg_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = decoded(_msg_files(spark, sf_dir), "msg", "attachments", strict_errors=True)
    return a.select("file_id", "filename", "mime_type", "size", F.sha2("data", 256).alias("sha"))


@query("SELECT n_nationkey AS file_id, n_name AS subject, 'multipart/mixed' AS content_type, 2 AS n_parts FROM nation")
def msg_to_eml(spark: SparkSession, sf_dir: str) -> DataFrame:
    eml = decoded(_msg_files(spark, sf_dir), "msg", "eml", strict_errors=True)
    top = parse_eml(eml, "file_id", "eml").filter(F.size("part_path") == 0)
    return top.select("file_id", c.get_header("headers", "subject").alias("subject"), "content_type", "n_parts")


@query("SELECT count(*) AS files, 12 * count(*) AS stream_rows, 3 * count(*) AS storages FROM nation")
def cfb_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decoded(_msg_files(spark, sf_dir), "msg", "cfb_dirents", strict_errors=True)
    return d.agg(F.count_distinct("file_id").alias("files"), F.count_if(F.col("type") == "stream").alias("stream_rows"), F.count_if(F.col("type").isin("storage", "root")).alias("storages"))


@query("SELECT r_regionkey AS file_id, type, count(*) AS n FROM (SELECT r_regionkey, 'folder' AS type FROM region UNION ALL SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'message' ELSE 'contact' END FROM nation) GROUP BY 1, 2")
def pst_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store for each region with its nations as items."""
    from ..session import ship

    ship(spark)
    n = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file_id")).agg(F.collect_list("n_nationkey").alias("keys"))

    def write(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        one = lambda own: synthetic.store_file([(0x21, 0, {0x3602: 1, 0x3001: "Top"}), *((1000 + int(k), 0x21, {0x001A: "IPM.Note" if k % 2 == 0 else "IPM.Contact", 0x0037: f"item {k}"}) for k in own)])
        return pd.Series([one(own) for own in keys])

    files = n.select("file_id", F.pandas_udf(write, "binary", F.PandasUDFType.SCALAR)("keys").alias("content"))
    return decoded(files, "pst", "pst_items", strict_errors=True).groupBy("file_id", "type").agg(F.count("*").alias("n"))


from . import containers  # noqa: E402, F401 - registers its queries here
