from __future__ import annotations

import random
import re

from postroom.llm.license_rules import GATES, SIGNATURES, keyword, rules
from postroom.llm.license_scan import PHRASES, scan_licenses


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    norm = "".join(f" {w} " for w in words)
    found = []
    for label, priority, _, pattern in rules():
        for m in re.finditer(pattern, norm):
            found.append((norm[: m.start()].count(" ") // 2, -(norm[: m.end()].count(" ") // 2), -priority, label))
    kept = []
    for k, (s, t, p, label) in enumerate(sorted(found)):
        if not any(a <= s and b <= t and q <= p for a, b, q, _ in sorted(found)[:k]):
            kept.append((label, -p))
    score = max([0.0, 0.9 * bool(places), *(p / 100 for _, p in kept)])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in kept})), score)


def test_against_brute_force(spark):
    rng = random.Random(3)
    phrases = [*PHRASES, "Licensed under the Apache License, Version 2.0", "GNU General Public License version 3", "the GNU Lesser General Public License", "CC-BY-NC-SA 4.0", "cc by nc cc by nc", "Creative Commons Attribution ShareAlike 4.0 International License", "released under the MIT license", "SPDX-License-Identifier: BSD-3-Clause", "Copyright 2020 A B. All rights reserved", "dual mit license license mit", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "placed in the public domain", "beerware license", "Mozilla Public License"]
    fill = ["the", "mit", "É", "été12", "license", "2", "|", "gnu", "x_y", "\x7f"]
    texts = [None, "", " .,", "under the mit", "cc by nc", *phrases]
    for _ in range(150):
        texts.append(rng.choice([" ", "\n", ", "]).join(rng.choice(phrases if rng.random() < 0.3 else fill) for _ in range(rng.randint(1, 40))))
    texts.append("under the mit license " * 500)
    rows = [(k, t, "a", 1) for k, t in enumerate(texts)] + [(None, "cc by nc", "b", 2), (5, texts[5], "b", 2)]
    df = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, norm string, labels int"))
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id] if r.doc_id is not None else "cc by nc"), (r, texts[r.doc_id or 0])
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_keywords_and_gates_hold_for_every_rule():
    assert len(rules()) > 200
    for label, patterns in SIGNATURES.items():
        for p in patterns:
            plain = re.sub(r"\(\?:[^()]*\)[?]|\{0,\d\}", "", p)
            assert keyword(p) and len(keyword(p)) >= 3, p
            assert any(g.strip() in plain.replace("[cs]", "c") for g in GATES), (label, p)


def test_gates_alone_pass_every_rule(spark):
    for _, _, _, pattern in rules():
        text = re.sub(r"\(\?:[^()]*\)\?", "", pattern).replace("[cs]", "c")
        text = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", text)
        assert any(g in text for g in GATES), pattern
    assert scan_licenses(spark.createDataFrame([(1, "CC0 1.0 Universal")], "doc_id bigint, text string")).filter("labels like '%cc0%'").count() == 1
