from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from postroom.llm import suffix_dedup
from postroom.llm.suffix_dedup import remove_repeats


def brute(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "öde", "stone", "漢字", "x"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(2000)) for _ in range(n))
    passages = [line(n) for n in (3, 8, 12, 40)]
    docs = []
    for k in range(70):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.5 else line(rng.randint(1, 30))
            if rng.random() < 0.3:
                p = p.replace("river", "rover", 1)
            parts.append(p)
        docs.append((k, rng.choice(["", " "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "ab" * 300), (103, "a" * 500), (104, docs[3][1]), (104, docs[3][1]), (None, docs[4][1]), (105, docs[5][1][7:]), (106, "ab" * 120)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("length", "gram", "batches", "crowd"), [(60, 12, 1, 10_000), (60, 12, 3, 2), (200, 40, 2, 10_000), (61, 30, 5, 4)])
def test_against_brute_force(spark, monkeypatch, length, gram, batches, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    docs = corpus(batches)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, rid string, start int").repartition(5)
    got = remove_repeats(df, length, gram, batches, digest=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs, length)


def framed(seed, n=300):
    """One passage between neighbours that differ in every document."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(45))
    return [(k, " ".join(word() for _ in range(rng.randint(0, 40))) + passage + " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize("crowd", [10_000, 50])
def test_a_passage_between_many_neighbours(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    docs = framed(crowd)
    got = remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), digest=True).collect()
    want = brute(docs, 200)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    assert all(removed >= 314 for _, _, removed, _, _ in want)


def test_a_batch_sends_few_entries_to_one_leader():
    docs = framed(7)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], ["rid", "text"])
    rows = pa.Table.from_batches(suffix_dedup._entries(200, 40)([batch])).to_pylist()
    own = Counter(r["leader"] for r in rows if r["state"] in (suffix_dedup.ONCE, suffix_dedup.AGAIN))
    sent = Counter(r["stretch"] for r in rows if r["state"] == suffix_dedup.SENT)
    assert max(own.values()) == suffix_dedup.WITNESSES and max(sent.values()) > 200 and set(sent) <= set(own)
    assert max(Counter(r["leader"] for r in rows).values()) <= 20


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_the_query_merges_levels(spark, monkeypatch, tmp_path):
    made = []

    class Watched(suffix_dedup.IndexFamily):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(suffix_dedup, "IndexFamily", Watched)
    docs = corpus(11)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs, 200)
    assert made[0].merges == 1 and [size for size, _ in made[0].levels] == [2, 1]
