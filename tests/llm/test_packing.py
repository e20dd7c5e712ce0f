from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from postroom.llm.packing import WordEncoder, pack_documents, pack_histogram

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_library_s():
    rng = random.Random(5)
    alphabet = "aabcdefthe  \n\t'sllt0129.,!?éüñÉΣ漢字😀\x85\x1c　-_#|é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["", "<|endoftext|>A<|startoftext|>", "it's WE'LL don't", "x" * 3000]
    t = Tokenizer.from_file(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert WordEncoder(PATH).encode(texts) == want


def test_histogram_is_packed_whole_and_tight():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.choice([10, 64, 2048])
        counts = defaultdict(int)
        for _ in range(rng.randint(1, 400)):
            counts[rng.randint(1, cap)] += rng.randint(1, 5)
        groups = pack_histogram(dict(counts), cap)
        got = defaultdict(int)
        for n, content in groups:
            assert sum(a * b for a, b in content) <= cap and n > 0
            assert sum(b for a, b in content if 3 * a > cap) <= 2
            for a, b in content:
                got[a] += n * b
        assert got == counts
        bins, least = sum(n for n, _ in groups), sum(a * b for a, b in counts.items()) / cap
        halves = sum(c for a, c in counts.items() if 2 * a > cap)
        assert bins <= 1.25 * max(least, halves) + 2


def test_rows(spark):
    schema = T.StructType.fromDDL("doc_id bigint, text string, offset string, rank string")
    words = ["the", "cat", "sat", "12", "!"]
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 300, 700, 1500, 5000]))), "a", "b") for k in range(300)]
    docs += [(1000, None, "a", None), (1000, None, "a", None), (None, "the", "a", "b"), (1001, "a", "", "")]
    rows = pack_documents(spark.createDataFrame(docs, schema), PATH).collect()
    t = Tokenizer.from_file(PATH)
    by_id = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, *_ in docs}
    bins = defaultdict(list)
    for r in rows:
        ids = by_id[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == sum(-(-len(by_id[d]) // 2048) for d, *_ in docs)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(len(by_id[d]) for d, *_ in docs) / 2048 + 1
    assert pack_documents(spark.createDataFrame([], schema), PATH).count() == 0
