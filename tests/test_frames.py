from __future__ import annotations

import os
import sys
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postroom.functions import columns as c
from postroom.functions import mime
from postroom.operators import decode, gates, hierarchy
from postroom.operators.decode import DECODERS, SCHEMAS, decoded, packed
from postroom.plans import catalogue
from postroom.session import ARROW_BYTES, ARROW_ROWS, BYTES_SETTING, ROWS_SETTING
from postroom.sources import datasource, files
from postroom.sources import synthetic as make
from postroom.streaming import drop_folder
from tests.test_containers import ITEMS, SUBSTITUTION, sample

SF = "/root/testdata/sf0.001"
EML = 'From: a@x.org\r\nSubject: =?UTF-8?Q?=C3=A9?=\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\n\r\none\r\n--q\r\nno colon\r\nA: 1\r\n\r\ntwo\r\n--q--\r\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    (root / "a.msg").write_bytes(sample())
    (root / "bad.msg").write_bytes(b"not a message")
    (root / "m.eml").write_text(EML, newline="")
    (root / "s.pst").write_bytes(make.store_file(ITEMS))
    return str(root)


@pytest.mark.parametrize(("kind", "table"), sorted(DECODERS))
def test_every_table_reads(spark, folder, kind, table):
    read = {"msg": files.read_msg, "eml": files.read_eml, "pst": files.read_pst}[kind]
    df = read(spark, folder, table)
    assert df.columns[0] == "file_id" and len(df.columns) == 1 + len(spark.createDataFrame([], SCHEMAS[table]).columns)
    rows = df.collect()
    assert rows or (kind, table) in (("pst", "warnings"), ("msg", "named_map"))


def test_readers(spark, folder):
    m = {r.obj_path: r for r in files.read_msg(spark, folder).collect()}
    assert m["/"].subject == "Grüße" and m["/"].sender_email == "ann@x.org" and m["/a2/"].subject == "Inner" and m["/"].delivered is not None
    assert [r.type for r in files.read_msg(spark, folder, "recipients").orderBy("obj_path", "ord").collect()] == ["to", "cc", "orig", "to"]
    w = {(os.path.basename(r.file_id), r.code) for r in files.all_warnings(spark, folder).collect()}
    assert w == {("bad.msg", "parse_error"), ("m.eml", "malformed_header_line")}
    parts = files.read_eml(spark, folder).orderBy("part_path").collect()
    assert [r.part_path for r in parts] == [[], [0], [1]] and parts[0].headers[1].value == "é"
    items = files.read_pst(spark, folder).orderBy("ord").collect()
    assert [(r.depth, r.type) for r in items] == [(0, "folder"), (1, "folder"), (2, "message"), (2, "task")]
    with pytest.raises(Exception, match="(?i)header too short|CfbError"):
        files.read_msg(spark, folder, strict_errors=True).collect()


def test_data_sources(spark, folder):
    datasource.register(spark)
    assert spark.read.format("mail_msg").load(folder).count() == 2
    r = spark.read.format("mail_pst").option("table", "pst_descriptors").load(folder)
    assert r.count() == 5 and spark.read.format("mail_eml").load(folder).filter("ord = 1").count() == 1
    assert spark.read.format("mail_msg").load(folder).filter(F.col("file_id") == f"{folder}/bad.msg").count() == 0


def test_tables_as_parameters(spark, tmp_path):
    (tmp_path / "coded.pst").write_bytes(make.store_file(ITEMS, SUBSTITUTION))
    names = lambda df: {r.display_name for r in df.collect()}
    assert names(files.read_pst(spark, str(tmp_path))) == {""}
    assert [r.code for r in files.read_pst(spark, str(tmp_path), "warnings").collect()] == ["pst_substitution_missing"]
    assert names(files.read_pst(spark, str(tmp_path), substitution=SUBSTITUTION)) == {"Top", "Inbox", "Hello", ""}
    datasource.register(spark)
    source = spark.read.format("mail_pst").option("substitution", SUBSTITUTION.hex()).option("tags", "0037 topic tstring")
    assert names(source.load(str(tmp_path))) == {"Top", "Inbox", ""}  # the subject goes by another name here
    assert "pr_topic" in {r.sym for r in source.option("table", "props").load(str(tmp_path)).collect()}
    raw = spark.createDataFrame([(1, sample())], "k int, bytes binary")
    assert files.parse_msg(raw, "k", "bytes").filter("obj_path = '/'").first().subject == "Grüße"
    store = spark.createDataFrame([(2, make.store_file(ITEMS, SUBSTITUTION))], "k int, bytes binary")
    assert files.parse_pst(store, "k", "bytes", "props", substitution=SUBSTITUTION, tags=[(0x0037, "topic", "tstring")]).filter("sym = 'pr_topic'").first().s == "Hello"


def test_stream(spark, folder, tmp_path):
    rows = drop_folder.arriving(spark, folder, "eml", "mime_parts")
    for _ in range(2):
        drop_folder.append_to(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_writers(spark, folder, tmp_path):
    eml = files.read_msg(spark, folder, "eml")
    files.write_eml(eml, str(tmp_path / "eml"))
    again = files.parse_eml(spark.read.json(str(tmp_path / "eml")), "file_id", "eml").filter(F.size("part_path") == 0).first()
    assert again.n_parts == 3 and c is not None
    files.write_snapshot(eml.select("file_id"), str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 1


def test_native_columns_agree_with_the_decoders(spark):
    values = ["plain", "käse", "漢字 x", "", "a=b\tc", "".join(map(chr, range(1, 300))), "%3D=3D+ %2B\r\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", c.encode_header("v").alias("h"), c.quoted_printable_units("v").alias("q"), c.base64_lines(F.encode(F.repeat("v", 40), "UTF-8")).alias("b"), c.decode_base64_word(c.encode_header("v")).alias("d")).collect()
    for r in got:
        assert r.h == mime.encode_header(r.v) and r.d == r.v and r.b == mime.base64_lines((r.v * 40).encode())
        assert r.q == mime.quoted_printable(r.v.encode()).replace("=\r\n", "")
    raw = spark.createDataFrame([(EML,), ("A: 1\n\nx",), ("no end",)], "raw string").select(c.split_message("raw").alias("m"), "raw")
    for r in raw.collect():
        assert (r.m.head, r.m.body) == mime.split_message(r.raw)
    h = spark.createDataFrame([("A: 1\r\n  more\r\nB:2\r\nbad\r\nb: 3",)], "h string").select(c.parse_headers("h").alias("h"))
    assert [(x.name, x.value) for x in h.first().h] == [("A", "1 more"), ("B", "2"), ("b", "3")]
    new = h.select(c.set_header("h", "b", F.lit("9")).alias("s"), c.add_header("h", "C", F.lit("4")).alias("a"), c.get_header("h", "B").alias("g")).first()
    assert [x.value for x in new.s] == ["1 more", "9", "3"] and new.a[-1].value == "4" and new.g == "2"


def test_gates(spark):
    one = spark.createDataFrame([("f", 1000, 5000, "s"), ("g", 10, 0, "s")], "file_id string, body_len long, html_len long, subject string")
    two = spark.createDataFrame([("f", 1129, 0, "t"), ("h", 1, 1, "s")], "file_id string, body_len long, html_len long, subject string")
    fails = {tuple(r) for r in gates.semantic_failures(one, two, "file_id", ["subject"]).collect()}
    assert fails == {("f", "subject"), ("f", "body_len"), ("f", "html_len"), ("f", "html_lost")}
    diff = {(r.file_id, r.field) for r in gates.baseline_diff(one, two, "file_id", ["subject"], {"body_len": gates.BODY}).collect()}
    assert diff == {("f", "subject"), ("f", "body_len"), ("g", "missing_row"), ("h", "extra_row")}
    assert {(r.field, r.left) for r in gates.field_diff(one, two, "file_id", ["subject"]).collect()} == {("subject", "s")}
    assert [r.failure for r in gates.eml_failures(one, two, "file_id", ["subject"]).collect()] == ["subject"]
    s = spark.createDataFrame([('"B" <B@x.org>, a@y.org',)], "v string").select(gates.normal_addresses(F.col("v")).alias("v"))
    assert s.first().v == "a@y.org,b@x.org"
    p = gates.store_probe(spark.createDataFrame([("f", "folder"), ("f", "message"), ("f", "task")], "file_id string, type string")).first()
    assert (p["items"], p.folders, p.messages) == (3, 1, 1)


def test_walk_ends_at_loops(spark):
    nodes = spark.createDataFrame([(1, 33, 0, 0), (1, 2, 33, 0), (1, 3, 2, 0), (1, 2, 3, 1), (1, 9, 9, 0)], "file_id int, id long, parent_id long, ord int")
    assert [(r.id, r.depth) for r in hierarchy.walk(nodes, 33).orderBy("path").collect()] == [(33, 0), (2, 1), (3, 2)]


def test_empty_and_null_input(spark):
    df = spark.createDataFrame([("x", None)], "file_id string, content binary")
    assert decoded(df, "eml", "mime_parts").count() == 1 and decoded(df, "msg", "messages").count() == 0
    assert [r.code for r in decoded(df, "msg", "warnings").collect()] == ["parse_error"]
    assert decoded(df.limit(0), "eml", "mime_parts").count() == 0


@pytest.mark.parametrize("table", ["eml", "mime_parts"])
def test_long_mails_go_in_small_batches(spark, table):
    for key in (ROWS_SETTING, BYTES_SETTING):
        spark.conf.unset(key)
    head = F.concat(F.lit("Subject: "), F.repeat(F.lit("word "), 4000), F.lit("\r\n\r\n"), F.repeat(F.lit("text "), 8000))
    mails = spark.range(0, 1500, 1, 1).select(F.col("id").alias("file_id"), head.alias("content"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = decoded(mails, "eml", table, strict_errors=True).mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in rows) == 1500 and max(r["size"] for r in rows) < 40 << 20


def test_round_trip_of_long_bodies(spark, tmp_path):
    for key in (ROWS_SETTING, BYTES_SETTING):
        spark.conf.unset(key)
    texts = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("漢 é\r\n\r\n"), "id"), 100_000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    back = catalogue.QUERIES["eml_roundtrip"](spark, str(tmp_path))
    assert {(r.doc_id, r.subject, r.body_sha256) for r in back.collect()} == {(r[0], "web", r[1]) for r in texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).collect()}
    assert (int(spark.conf.get(ROWS_SETTING)), int(spark.conf.get(BYTES_SETTING))) == (ARROW_ROWS, ARROW_BYTES)


def test_a_batch_is_decoded_bit_by_bit():
    schema = pa.schema([("file_id", pa.int64()), ("eml", pa.string())])
    taken = []

    def rows():
        for k in range(3000):
            taken.append(k)
            yield k, "x" * (100_000 if k < 1000 else 10)

    sizes, first = [], None
    for b in packed(rows(), schema):
        first = first or len(taken)
        sizes.append((b.num_rows, b.nbytes))
    assert sum(n for n, _ in sizes) == 3000 and first < 200
    assert max(n for n, _ in sizes) <= ARROW_ROWS and max(x for _, x in sizes) < ARROW_BYTES + 200_000


def test_batches_of_wide_signs_are_bounded_in_bytes_and_keep_no_rows():
    schema = pa.schema([("file_id", pa.int64()), ("eml", pa.string())])
    sizes, kept = [], []
    assert len(list(packed([(0, "a")], schema))) == 1  # loads what the first batch loads
    tracemalloc.start()
    for b in packed(((k, "漢" * (100_000 + k)) for k in range(200)), schema):
        sizes.append((b.num_rows, b.nbytes))
        kept.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 200 and max(x for _, x in sizes) < 2 * ARROW_BYTES and max(kept) < 100_000


def test_a_long_mail_is_copied_few_times():
    raw = "Subject: web\r\n\r\n" + "漢" * 3_000_000
    tracemalloc.start()
    again = list(DECODERS["eml", "eml"](raw))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again == [(raw,)] and most < 3 * sys.getsizeof(raw)


def test_what_is_no_text_is_replaced_wherever_it_stands():
    for text in ("", "abc", "é漢\U0001f468", "\udc80", "é" * 3_000_000, "é" * 3_000_000 + "\udcff", "\udce9" + "漢" * 2_000_000):
        assert decode._text(text) == text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    with pytest.raises(UnicodeEncodeError):
        decode._text("\ud800")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_their_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted((tuple(r[k] for k in cols) for r in got.collect()), key=repr) == sorted(want.project(", ".join(cols)).fetchall(), key=repr)


def test_deep_and_wide_trees(spark):
    deep = spark.range(1, 3001).select(F.lit(1).alias("file_id"), F.col("id"), (F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"))
    rows = hierarchy.walk(deep, 1).agg(F.count("*").alias("n"), F.max("depth").alias("depth")).first()
    assert (rows.n, rows.depth) == (3000, 2999)
    wide = spark.range(1, 1_100_002).select(F.lit(1).alias("file_id"), F.col("id"), F.when(F.col("id") == 1, 0).when(F.col("id") < 8, 1).otherwise(1 + F.col("id") % 7).alias("parent_id"), F.col("id").alias("ord"))
    assert hierarchy.walk(wide, 1).agg(F.count("*")).first()[0] == 1_100_001


def test_chains_end(spark):
    links = [(k, k + 1) for k in range(1, 2500)] + [(5001, 5002), (5002, 5003), (5003, 5002), (6001, 6001), (7001, None)]
    starts = spark.createDataFrame([(1,), (5001,), (6001,), (7001,), (9,)], "start bigint")
    rows = hierarchy.chain(spark.createDataFrame(links, "id bigint, next bigint"), starts).groupBy("start").agg(F.count("*").alias("n"), F.max("hop").alias("last"))
    assert {(r.start, r.n, r["last"]) for r in rows.collect()} == {(1, 2500, 2499), (9, 2492, 2491), (5001, 3, 2), (6001, 1, 0), (7001, 1, 0)}
