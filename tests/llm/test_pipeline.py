"""The pipeline's stages against plain Python, each on the input that the stage itself gets."""

from __future__ import annotations

import random

import corpus_pipeline
from postroom.llm.decontamination import RATE, Matcher, normal
from tests.llm.test_line_dedup import LOWER, STRIP
from tests.llm.test_simhash import brute_components, brute_print

ITEM = "a test item about the quiet harbour where nine grey boats wait for the tide that never seems to come"


def corpus():
    rng = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for k in range(240):
        text = "\n".join(line(rng.randint(6, 25)) for _ in range(rng.randint(3, 8)))
        toxic = int(k % 6 == 0)
        if toxic:
            parts = text.split(" ")
            for _ in range(8):
                parts.insert(rng.randrange(len(parts)), rng.choice(["grumblesnot", "vilefaced", "rotbrained"]))
            text = " ".join(parts)
        docs.append([k, text, "en", "src", len(text)])
        labels.append((k, 1, toxic))
    clean = [d for d in docs if d[0] % 6]
    for n, d in enumerate(clean[:10]):
        docs.append([1000 + n, d[1].replace("\n", " ", 1), "en", "src", len(d[1])])
    for n, d in enumerate(clean[20:25]):
        d[1] += "\n" + ITEM.upper() + f" end {n}"
        d[4] = len(d[1])
    for d in clean[30:60]:
        d[1] += "\nThis footer line stands in many of the documents"
        d[4] = len(d[1])
    docs += [[2000, None, "en", None, None], [2001, "", "en", "src", 0]]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{n}")
        df = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = {r.doc_id: r for r in df.collect()} if name != "packing" else df.collect()
    toxic = {k for k in range(240) if k % 6 == 0}
    assert set(seen["toxicity"]) == {d[0] for d in docs} - toxic
    # Lines: those of a smaller doc_id go.
    before = {k: (r.text or "").split("\n") for k, r in seen["toxicity"].items()}
    key = lambda x: x.strip(STRIP).translate(LOWER)
    first = {}
    for k in sorted(before):
        for x in before[k]:
            if len(key(x)) >= 10:
                first.setdefault(key(x), k)
    for k, r in seen["line_dedup"].items():
        assert (r.text or "") == "\n".join(x for x in before[k] if first.get(key(x), k) == k)
        assert r.text is None or r.n_chars == len(r.text)
    items = [(k, brute_print(r.text)) for k, r in seen["line_dedup"].items()]
    assert set(seen["near_dedup"]) == {k for (k, _), c in zip(items, brute_components(items), strict=True) if k == c}
    m = Matcher([normal(ITEM)], RATE)
    left = {k for k, r in seen["near_dedup"].items() if not m.matches(normal(r.text))}
    assert set(seen["decontamination"]) == left and len(left) == len(seen["near_dedup"]) - 5
    assert {r.doc_id for r in seen["packing"]} == left
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in cols) for r in run) == sorted(tuple(r[c] for c in cols) for r in seen["packing"])
