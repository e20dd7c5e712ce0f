"""Line deduplication across documents, built from DataFrame functions alone.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points that two or more documents hold stay in
the smallest doc_id only.

Method: keys travel as 128-bit hashes, dealt by ranges of the hash and sorted by document
and position within a range; a running window streams over each key's rows and knows the
first document. It does so twice. In the first pass a key's range is spread over a quarter
of the partitions by document, so that a line of a third of all rows meets no single task:
rows behind the first document of their slice go at once. The second pass sees one document
a slice and key, at most as many as there are slices. Positions that go become bitmaps of
64-bit words; only words that lose a line are kept, and no text is shuffled for them. The
text itself moves once, to meet its bitmap.

Defined results: null text is one empty line; rows with a null doc_id neither hold nor
lose lines; repeated rows and rows that share a doc_id are one document to the rule, and
each keeps a bitmap of its own text; an empty table gives an empty result; columns other
than those read pass through ``apply_bitmaps`` untouched, those that it makes replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does it alone where no other letter has a case to lose."""
    plain = F.length(text) == F.octet_length(text)
    cased = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain | ~cased, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc_id, text_hash, pos`` of every line long enough."""
    lines = docs.filter("doc_id is not null").select(
        "doc_id", F.xxhash64(body()).alias("text_hash"), F.posexplode(F.split(ascii_lower(body()), "\n", -1)).alias("pos", "line")
    )
    key = F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM line)")
    keys = lines.select("doc_id", "text_hash", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _first(rows: DataFrame, slices: Column, n: int) -> DataFrame:
    """Rows with ``first``, the smallest document that its slice of the key's rows has."""
    reach = F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * n)
    dealt = rows.withColumn("slot", F.pmod(reach + slices, F.lit(n)).cast("int")).repartitionById(n, F.col("slot"))
    w = Window.partitionBy("slot", "h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("first", F.first("doc_id").over(w))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, keep``: for documents that lose lines, the words of the keep bitmap that aren't all ones."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = line_keys(docs, min_chars)
    near = _first(rows, F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // 4))), n)
    behind = near.filter("doc_id > first").select("doc_id", "text_hash", "pos")
    heads = _first(near.filter("doc_id = first").select(*rows.columns), F.lit(0), n)
    gone = behind.unionByName(heads.filter("doc_id > first").select("doc_id", "text_hash", "pos"))
    words = gone.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.expr("~bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its text cut down, and ``n_lines`` (before) and ``n_dropped``."""
    own = docs.drop("n_lines", "n_dropped").withColumn("__hash", F.xxhash64(body()))
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"), F.col("keep").alias("__keep"))
    both = own.join(marks, (F.col("doc_id") == F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left")
    both = both.withColumn("n_lines", (F.length(body()) - F.length(F.replace(body(), F.lit("\n"), F.lit(""))) + 1).cast("long"))
    both = both.withColumn(
        "__words",
        F.when(
            F.col("__keep").isNotNull(),
            F.transform(F.sequence(F.lit(0), F.floor((F.col("n_lines") - 1) / 64).cast("int")), lambda w: F.coalesce(F.try_element_at("__keep", w), F.lit(-1).cast("long"))),
        ),
    )
    both = both.withColumn(
        "__lines",
        F.when(
            F.col("__keep").isNotNull(),
            F.expr(r"filter(split(coalesce(text, ''), '\n', -1), (x, i) -> (shiftright(get(__words, cast(i div 64 as int)), cast(i % 64 as int)) & 1L) = 1L)"),
        ),
    )
    cut = F.col("__keep").isNotNull()
    both = both.withColumn("n_dropped", F.when(cut, F.col("n_lines") - F.size("__lines")).otherwise(0).cast("long"))
    both = both.withColumn("text", F.when(cut, F.array_join("__lines", "\n")).otherwise(F.col("text")))
    return both.drop("__hash", "__doc", "__text", "__keep", "__words", "__lines")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(body().cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.first_doc < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.first_doc IS NULL OR f.first_doc = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
