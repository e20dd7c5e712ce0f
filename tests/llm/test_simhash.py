from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from postroom.llm import simhash
from postroom.llm.components import connected
from postroom.llm.simhash import fingerprint, keep_one, links, near_components


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fp = np.array([f for _, f in items], np.uint64)
    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


def test_documents(spark):
    rng = random.Random(1)
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}É" for _ in range(rng.choice([1, 3, 4, 5, 200, 900]))]
        for c in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(c if len(own) > 100 else 0):
                own[rng.randrange(len(own))] = "CHANGED"
            docs.append((1000 * k + c, rng.choice([" ", "\n", "\t "]).join(own)))
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, docs[5][1]), (None, "quite alone here now"), (99991, None), (99992, ""), (99993, " \n")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, fp int, component_id string")
    rows = near_components(df).collect()
    want = brute_components([(d, brute_print(t)) for d, t in docs])
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in rows), key=key) == sorted(((d, brute_print(t), w) for (d, t), w in zip(docs, want, strict=True)), key=key)
    kept = [r.doc_id for r in keep_one(df).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(d for (d, _), w in zip(docs, want, strict=True) if d is not None and d == w)
    assert near_components(df.limit(0)).count() == 0


def test_layouts_bound_the_residents_of_an_anchor():
    n = 10_000
    while n <= 1.6e10:
        blocks, chosen, code = simhash.layout(n)
        for key in simhash.keys(blocks, chosen):
            width = sum(w for _, w in key)
            assert n / 2 ** (width - code.bit_length()) <= 250 and width <= 33
        n *= 2


@pytest.mark.parametrize("how", [(3, 1, 15), (5, 2, 15), (6, 3, 31)])
def test_visitors_reach_every_near_anchor(how):
    blocks, chosen, code = how
    for key in simhash.keys(blocks, chosen)[:2]:
        width = sum(w for _, w in key)
        masks = simhash.visitor_masks(width, code)
        rng = random.Random(0)
        syndrome = lambda x: int(np.bitwise_xor.reduce([0] + [p for p in range(1, code + 1) if x >> (p - 1) & 1]))
        home = lambda x: x ^ (1 << (s - 1) if (s := syndrome(x)) else 0)
        for _ in range(50):
            x = rng.getrandbits(width)
            reach = {x ^ m for m in masks[syndrome(x)]}
            assert home(x) in reach and all(home(x ^ 1 << b) in reach for b in range(width))


@pytest.mark.parametrize(("crowd", "most"), [(20_000, 2e7), (5, 2e7), (20_000, 0), (3, 0), (20_000, -1)])
def test_links_are_complete(spark, crowd, most, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    if most < 2e7:  # the finer layouts
        monkeypatch.setattr(simhash, "LAYOUTS", ((0, 3, 1, 15), *simhash.LAYOUTS[1:]) if most == 0 else ((0, 3, 1, 15), simhash.LAYOUTS[2]))
    monkeypatch.setattr(simhash, "LINKS", 50 if crowd == 5 else 50_000)
    rng = random.Random(2)
    fps = {0, 2**64 - 1}
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 7)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    x = rng.getrandbits(64)
    fps |= {x ^ (1 << a) ^ (1 << b) for a in range(18) for b in range(18)}
    items = [(k, f) for k, f in enumerate(sorted(fps))]
    signed = [(int(np.uint64(f).astype(np.int64)),) for _, f in items]
    roots = {r.node: r.root for r in connected(links(spark.createDataFrame(signed, "fp bigint"))).collect()}
    groups = {}
    for (k, _), (s,) in zip(items, signed, strict=True):
        groups.setdefault(roots.get(s, s), []).append(k)
    least = {k: min(g) for g in groups.values() for k in g}
    assert [least[k] for k, _ in items] == brute_components(items)


def test_long_path(spark):
    ids = [(k, k + 1) for k in range(300)]
    random.Random(0).shuffle(ids)
    assert {(r.node, r.root) for r in connected(spark.createDataFrame(ids, "a bigint, b bigint")).collect()} == {(k, 0) for k in range(1, 301)}


def test_fingerprint_of_a_long_text():
    text = "Aa bB " * 20_000
    assert fingerprint(text) == brute_print(text)
