from __future__ import annotations

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postroom.llm import common
from postroom.llm.license_scan import scan_licenses
from postroom.llm.quality_rules import learn_rules
from postroom.llm.token_counts import count_tokens


def test_settings_come_back(spark):
    spark.conf.set(common.ROWS_SETTING, "77")
    with common.setting(spark, common.ROWS_SETTING, "65536"):
        assert spark.conf.get(common.ROWS_SETTING) == "65536"
    assert spark.conf.get(common.ROWS_SETTING) == "77"
    common.arrow_batches(spark)
    assert spark.conf.get(common.ROWS_SETTING) == "512" and spark.conf.get(common.BYTES_SETTING) == str(16 << 20)


def test_long_texts_come_in_small_batches(spark):
    common.arrow_batches(spark)
    docs = spark.range(0, 512, 1, 1).select("id", F.repeat(F.lit("a bc "), 200_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in rows) == 512 and max(r["size"] for r in rows) < 40 << 20


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_many_hits_in_one_text(spark):
    text = "Under the MIT License. " * 50_000 + "Apache License, Version 2. " * 50_000
    started = time.time()
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert time.time() - started < 60
    assert (row.n_base, row.first_word, row.last_word) == (100_000, 0, 200_000 + 4 * 49_999)
    assert row.base_labels == "apache-2,mit"


def test_rules_of_string_ids_and_repeated_rows(spark):
    texts = [("k%d" % k, " ".join(["###" if k % 2 else "word"] * 5 + [f"w{k}x{j}" for j in range(30)]), int(k % 2 == 0)) for k in range(300)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id string, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in texts], "doc_id string, quality int")
    rules = learn_rules(docs, labels)
    assert rules
    many = spark.range(10_000).select(F.lit("k3").alias("doc_id"), F.concat(F.lit("zz "), F.col("id").cast("string")).alias("text"))
    assert learn_rules(docs.unionByName(many).repartition(7), labels) == rules


def test_counts_of_long_texts_beside_short_ones(spark):
    docs = spark.createDataFrame([(k, "some words " * (20_000 if k % 9 == 0 else 1)) for k in range(40)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_bytes for r in count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).select("doc_id", "n_bytes").collect()}
    assert got == {k: 11 * (20_000 if k % 9 == 0 else 1) for k in range(40)}
