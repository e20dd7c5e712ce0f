from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from postroom.llm.token_counts import RankMerger, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    alphabet = "aaabcdefthe  \n\t'sll0129.,!?éüñ漢字😀\x1c\x85 　-_#"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return out + ["", "a" * 5000, "ab" * 3000, " " * 400 + "x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "it's they'll WE'VE", "\n\n  \n x"]


def test_same_counts_as_the_library():
    t = Tokenizer.from_file(PATH)
    want = [len(e.ids) for e in t.encode_batch(texts(), add_special_tokens=False)]
    assert RankMerger(PATH).texts(texts()) == want


def test_rows(spark):
    schema = T.StructType.fromDDL("id string, doc_id bigint, text string, n_tokens string")
    rows = [("x", 1, None, "?"), ("x", 2, "", "?"), ("x", 2, "the the", "?"), ("x", None, "the " * 2000, None)]
    got = count_tokens(spark.createDataFrame(rows, schema), PATH, 1024)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 7, 2, False), (None, 8000, 2001, True)], key=str)
    assert count_tokens(spark.createDataFrame([], schema), PATH, 1024).count() == 0
