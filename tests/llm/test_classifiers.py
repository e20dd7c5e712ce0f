from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postroom.llm import toxicity
from postroom.llm.quality import classify_quality, labelled
from postroom.llm.toxicity import classify_toxicity, fit, reject_toxic, windows

DOCS = "doc_id bigint, text string, label string, held_out string, score string, lang string, source string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def tables(spark, n=600):
    rng = random.Random(9)
    plain = ["the", "river", "of", "stone", "and", "light", "walks", "over", "fields", "slowly", "again", "winter"]
    docs, labels = [], []
    for k in range(n):
        toxic, good = int(k % 5 == 0), int(k % 3 != 0)
        words = [rng.choice(plain) for _ in range(rng.randint(40, 120))]
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgface", "blarghead", "zorgling"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words), "x", "y", "z", "en", "s"))
        labels.append((k, good, toxic, "other"))
    docs += [(9001, None, *"xyzab"), (9002, "", *"xyzab"), (None, "the river", *"xyzab"), (9003, "stone " * 30000, *"xyzab"), (3, docs[3][1], *"xyzab")]
    labels += [(None, 1, 1, ""), (9001, None, None, ""), (5, None, 1, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def check(rows, n, modulus, held, truth):
    assert len(rows) == n + 5
    right = total = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        if r.held_out and r.doc_id < 9000:
            total += 1
            right += r.predicted == truth(r.doc_id)
    assert right >= 0.95 * total


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    check(classify_quality(docs, labels).collect(), 600, 4, 2, lambda k: int(k % 3 != 0))
    check(classify_toxicity(docs, labels).collect(), 600, 3, 1, lambda k: int(k % 5 == 0))
    kept = reject_toxic(docs, fit(docs, labels, 3, 1))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {k for k in range(600) if k % 5} <= ids and len([k for k in range(600) if k % 5 == 0 and k in ids]) < 6


def test_empty_and_one_class(spark):
    docs, labels = tables(spark, 20)
    for f, name in ((classify_quality, "quality"), (classify_toxicity, "toxic")):
        assert f(docs.limit(0), labels).count() == 0
        assert {r.score for r in f(docs, labels.limit(0)).collect()} == {0.5}
        assert {r.predicted for r in f(docs, labels.filter(f"{name} = 1")).collect()} == {0}


def test_toxic_marks_of_a_minority(spark):
    """Marks of few documents count beside those of a language with many more."""
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(1200):
        few, toxic = k % 20 == 1, int(k % 4 == 0 or k % 40 == 1)
        words = [rng.choice(["colina", "viento", "piedra", "sombra", "camino"] if few else ["river", "stone", "light", "field", "winter"]) for _ in range(60)]
        if toxic:
            for at in rng.sample(range(60), 6):
                words[at] = "bomentez" if few else rng.choice(["zorgface", "zorgling"])
        docs.append((k, " ".join(words), "x", "y", "z", "en", "s"))
        labels.append((k, None, toxic, ""))
    rows = classify_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).filter("held_out").collect()
    rare = [r.predicted for r in rows if r.doc_id % 40 == 1]
    assert len(rare) >= 5 and all(rare)
    assert not [r.doc_id for r in rows if r.predicted and r.doc_id % 4 and r.doc_id % 40 != 1]


REAL = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not REAL.exists(), reason="needs the synthetic tables")
def test_toxicity_of_the_tables_held_out(spark):
    docs, labels = (spark.read.parquet(f"{REAL}/{n}.parquet") for n in ("documents", "labels"))
    rows = classify_toxicity(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id")
    rows = rows.select("toxic", "predicted", F.percent_rank().over(Window.orderBy("score")).alias("rank")).collect()
    toxic, other = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 100 and len(other) > 1000
    assert sum(r.predicted for r in toxic) >= 0.4 * len(toxic)
    assert sum(r.predicted for r in other) <= 0.02 * len(other)
    assert sum(r["rank"] for r in toxic) / len(toxic) > sum(r["rank"] for r in other) / len(other) + 0.2


def test_a_doc_id_of_many_rows_counts_once(spark):
    docs, labels = tables(spark)
    many = spark.range(10_000).select(F.lit(30).cast("bigint").alias("doc_id"), F.concat(F.lit("zz row "), F.col("id").cast("string")).alias("text"))
    rows = labelled(docs.select("doc_id", "text").unionByName(many), labels, "toxic", 3, 1).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    kept = labelled(docs, labels, "toxic", 3, 1, 50).collect()
    assert len(kept) == 50 and {r.doc_id for r in kept} <= {r.doc_id for r in rows}
    few = labelled(docs, labels, "toxic", 3, 1, 50, 4_000).collect()
    assert sum(len(r.text) for r in few) <= 4_000 and 0 < len(few) < 50 and {r.doc_id for r in few} <= {r.doc_id for r in kept}


def test_windows_hold_the_whole_text():
    text = "Aa b" + "x" * 100 + " é ß\n\tend"
    assert b"".join(b"".join(windows(text)).split()) == "".join(text.lower().split()).encode()
    assert windows(None) == windows(" ") == [b"  "]


class Counted:
    """In place of a coder: a size made of the window's bytes, and how many were asked for."""

    def __init__(self, dictionary):
        self.dictionary, self.asked = dictionary, 0

    def sizes(self, parts):
        self.asked += len(parts)
        return np.array([zlib.crc32(self.dictionary + w) % 20 for w in parts], np.int64)


def stub_model(monkeypatch):
    coders = {}
    monkeypatch.setattr(toxicity, "coder", lambda d: coders.setdefault(d, Counted(d)))
    monkeypatch.setattr(toxicity, "_PAIRS", {})
    n = toxicity.N_FEATURES
    flat, one = np.zeros(n), np.ones(n)
    return toxicity.Model(b"plain", b"toxic", 0, flat, one * 99, flat, one, np.linspace(-1, 1, n + 1) / 20, 0.25), coders


def test_windows_met_before_are_not_compressed_again(monkeypatch):
    model, coders = stub_model(monkeypatch)
    texts = [" ".join(f"w{i % 2000} v{i // 2000}" for i in range(k, k + 50_000)) for k in range(0, 1_200_000, 50_000)]
    first = model.score(texts)
    asked = coders[b"toxic"].asked
    assert asked == 1_200_000
    assert (model.score(texts) == first).all()
    assert coders[b"toxic"].asked - asked < 0.01 * asked


def test_a_full_memory_changes_no_score(monkeypatch):
    model, _ = stub_model(monkeypatch)
    rng = random.Random(5)
    texts = [None, "", "Aa", "a " * 999, "x" * 100] + [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(300))) for _ in range(200)]
    want = model.score(texts)
    cost, plain = Counted(b"toxic"), Counted(b"plain")
    for text, x in zip(texts, toxicity.texts_gains(texts, b"plain", b"toxic"), strict=True):
        c = cost.sizes(windows(text))
        assert (x == np.where(c <= toxicity.DEAR, plain.sizes(windows(text)) - c, toxicity.NONE)).all()
    for memory, words, at_once in ((16, 20, 50), (256, 40, 1), (1024, 1000, 10_000)):
        monkeypatch.setattr(toxicity, "_PAIRS", {})
        for name, value in (("MEMORY", memory), ("WORDS", words), ("AT_ONCE", at_once)):
            monkeypatch.setattr(toxicity, name, value)
        for some in (texts, texts[::-1]):
            got = model.score(some)
            assert (got == (want if some is texts else want[::-1])).all()
