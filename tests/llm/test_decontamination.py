from __future__ import annotations

import random

from postroom.llm import decontamination
from postroom.llm.decontamination import Matcher, budget, decontaminate, find_leaks, normal, pieces


def edit_distance(item, text):
    """Least distance of the item to any stretch of the text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[:], 0
        for i, x in enumerate(item, 1):
            row[i] = min(prev[i - 1] + (x != c), prev[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        rng.choice([lambda: s.__setitem__(k, "Z"), lambda: s.pop(k), lambda: s.insert(k, "Q")])()
    return "".join(s)


def test_matches_equal_the_plain_table():
    rng = random.Random(6)
    words = ["of", "the", "river", "stone", "light", "über", "winter", "an"]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 30]))) for _ in range(12)] + ["", "the"]
    m = Matcher(items, decontamination.RATE)
    for item in items:
        if item:
            assert "".join(p for _, p in pieces(item)) == item and len(pieces(item)) == budget(len(item)) + 1
    for _ in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:-2])
            text += " " + mutate(rng, item, rng.randint(0, budget(len(item)) + 2)) + " " + rng.choice(words)
        text = normal(text)
        got = {k: (d, a, b) for k, d, a, b in m.matches(text)}
        for k, item in enumerate(items):
            d = edit_distance(item, text) if item else 99
            assert (k in got) == (d <= m.limits[k]), (item, text)
            if k in got:
                assert got[k][0] == d == edit_distance(item, text[got[k][1] : got[k][2]])


def test_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then sleeps for the rest of the long day"
    other = "a wholly different passage about rivers and the stones that they carry to the sea each spring"
    docs = [(1, "x " * 500 + item.upper().replace(" ", " \n ") + " y"), (2, item.replace("quick", "quikc")), (3, item[:40]), (4, None), (5, ""), (None, other), (2, other + item)]
    d = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id bigint, text string, distance int, item_id string")
    b = spark.createDataFrame([(10, item, 1), (11, other, 1), (12, None, 1), (13, "", 1), (None, other, 2)], "item_id int, text string, doc_id int")
    want = sorted([(1, 10, 0), (2, 10, 2), (2, 10, 0), (2, 11, 0), (2, None, 0), (None, 11, 0), (None, None, 0)], key=str)
    for size in (2_000_000, 60):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        got = find_leaks(d, b)
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got.collect()), key=str) == want
        assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [3, 4, 5]
    assert decontaminate(d, b).columns == d.columns
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == len(docs)
