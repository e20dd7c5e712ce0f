from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.llm.line_dedup import dedup_lines

STRIP = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    keys = defaultdict(set)
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                keys[line.strip(STRIP).translate(LOWER)].add(d)
    out = []
    for d, t in docs:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            k = line.strip(STRIP).translate(LOWER)
            if d is None or len(k) < 10 or len(keys[k]) < 2 or min(keys[k]) == d:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"Line number {k} of the pool" for k in range(30)] + ["short", "", "  LINE Number 3 of the pool\t", "ÉCOLE É 12345", "école é 12345", "ÉCOLE é 12345", "x" * 20]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 40, 300])))) for k in range(200)]
    docs += [(500 + k, "The very common line of all\nown %d line here" % k) for k in range(400)]
    docs += [(None, "The very common line of all\nx"), (7, "Line number 3 of the pool"), (7, "Line number 3 of the pool"), (900, None), (901, ""), (902, "\n\n")]
    rng.shuffle(docs)
    schema = T.StructType.fromDDL("doc_id bigint, text string, n_lines string, first bigint, slot int")
    df = spark.createDataFrame([(d, t, "?", 1, 2) for d, t in docs], schema)
    got = dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0


def test_letter_f_and_form_feed_at_the_ends(spark):
    pool = ["for a test", "foo bar baz", "oo bar baz", "a line to cut off", "a line to cut o", "FOR A TEST", "\x0cfoo bar baz", "foo bar baz\x0c", "\x0b\x0c\r a line to cut off\t\x0c", "\x0cshort one"]
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.sample(pool, 3))) for k in range(60)] + [(100 + k, line) for k, line in enumerate(pool)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)
