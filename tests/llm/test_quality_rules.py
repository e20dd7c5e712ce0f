from __future__ import annotations

import random
import re

import numpy as np

from postroom.llm.quality_rules import FEATURES, apply_rules, learn, learn_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 10 or 100 * len(again) > 20 * n)


def test_statistics_and_verdicts(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n\x0b\f\r", "a b c d e a b c d e", "x " * 300, "same line\nsame line\n\nsame line ", "one two three four five six seven eight nine ten", "ü é ñ #*$%&|<> " * 3]
    for _ in range(150):
        v = rng.choice([3, 8, 500])
        texts.append("".join(rng.choice(["w%d" % rng.randrange(v), "É%d" % rng.randrange(v), "#"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.choice([0, 4, 9, 10, 60, 800]))))
    labels = []
    good = len(texts)
    for k in range(400):
        bad = k % 4 == 0
        texts.append(" ".join(("w%d" % rng.randrange(9999)) + ("###" if bad else "") for _ in range(rng.randint(20, 60))))
        labels.append((good + k, int(not bad), "x"))
    docs = spark.createDataFrame([(k, t, 0, "z", True) for k, t in enumerate(texts)] + [(3, texts[3], 0, "z", True), (None, "a", 0, "z", True)], "doc_id bigint, text string, n_words int, words string, kept boolean")
    label_rows = spark.createDataFrame([*labels, (None, 1, ""), (1, None, "")], "doc_id bigint, quality int, n_words string")
    rules = learn_rules(docs, label_rows)
    assert rules and all(t.sql() for rule in rules for t in rule)
    rows = apply_rules(docs, rules).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "a")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r
        assert r.kept == (not r.base_failed and r.rule == 0)
        if r.doc_id is not None and r.doc_id >= good:
            assert r.kept == (((r.doc_id - good) % 4) != 0)
    assert learn_rules(docs, label_rows.limit(0)) == []
    assert apply_rules(docs.limit(0), rules).count() == 0


def test_learning_separates_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    keep = ~((x[:, 0] > 0.7) & (x[:, 3] < 0.4))
    rules = learn(x, keep.astype(int), list(FEATURES))
    got = np.ones(len(x), bool)
    for rule in rules:
        m = np.ones(len(x), bool)
        for t in rule:
            m &= t.holds(x, list(FEATURES))
        got &= ~m
    assert (got == keep).mean() > 0.97
