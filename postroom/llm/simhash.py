"""Near-duplicate documents by SimHash.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 (seed 42) of its
four-word shingles. Fingerprints that differ in at most four bits are linked.

Method: anchor-point covering. The fingerprint falls into blocks, of which some make a key:
one of three blocks (21 bits), two of five (25), or three of six (31), every choice in
turn. Four differing bits leave at least one key with at most one: of three blocks one, of
five two, of six three hold at most one between them. On a key the anchors are a covering
code: a perfect Hamming code on 15 or 31 bits and every value of the rest, so no key is
further than 1 from its home anchor. A fingerprint goes to its home as a resident, and to
every anchor within covering radius plus threshold (2) as a visitor. Two fingerprints whose
keys differ in at most one bit meet at the home of either, so residents against visitors,
anchor by anchor, finds every link.

The layout follows from the number of different fingerprints (``LAYOUTS``), so that anchors
grow with it: a home has at most about 250 residents on average up to 1.6e10 fingerprints,
and work grows in proportion to their number but for the steps between layouts (45, 220 and
340 visitor rows a fingerprint).

Comparison streams: partitions are sorted by anchor with residents first; a task holds one
anchor's residents (8 bytes each) and compares batches of visitors with them. Batches with
many links leave a spanning forest of them, so a dense group costs its nodes, not its
pairs. Anchors with more than ``CROWD`` residents are salted: their residents are copied to
each slice, their visitors dealt out. Copies share a fingerprint and are one row from the
start.

Defined results: null and empty texts have fingerprint zero and link like any other; a
null doc_id gets the smallest doc_id reachable (null if there is none); repeated rows give
a row each; an empty table an empty result. Only the listed columns come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_SETTING, Scratch, arrow_batches, checkpointed, setting, table
from .components import connected

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Up to how many different fingerprints: blocks, blocks in a key, and the key's lowest bits that carry the code.
LAYOUTS = ((2e7, 3, 1, 15), (5e8, 5, 2, 15), (float("inf"), 6, 3, 31))
CROWD, PAIRS, LINKS = 20_000, 4_000_000, 50_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long); no shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def layout(n: float) -> tuple[int, int, int]:
    """Blocks, blocks in a key and bits of the code for ``n`` different fingerprints."""
    return next(rest for most, *rest in LAYOUTS if n <= most)


def keys(blocks: int, chosen: int) -> list[list[tuple[int, int]]]:
    """For every key the first bit and width of each of its blocks."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [list(c) for c in combinations(parts, chosen)]


def _key(parts: list[tuple[int, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for first, width in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _syndrome(key: Column, code: int) -> Column:
    """Of the code's bits: 0 on the code, else the number of the bit that leads back to it."""
    out = F.lit(0)
    for j in range(code.bit_length()):
        mask = sum(1 << (p - 1) for p in range(1, code + 1) if p >> j & 1)
        out = out + F.bit_count(key.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << j)
    return out.cast("int")


def visitor_masks(width: int, code: int) -> list[list[int]]:
    """By syndrome: what to XOR a key with to reach every anchor within two bits."""
    free = [1 << p for p in range(code, width)]
    pairs = [a | b for k, a in enumerate(free) for b in free[k + 1 :]]
    out = [[0, *free, *pairs]]
    for s in range(1, code + 1):
        near = [1 << (s - 1) | f for f in (0, *free)]
        far = [1 << (a - 1) | 1 << (b - 1) for a in range(1, code + 1) for b in range(a + 1, code + 1) if a ^ b == s]
        out.append(near + far)
    return out


def _anchors(distinct: DataFrame, resident: bool, blocks: int, chosen: int, code: int) -> DataFrame:
    """``anchor, visitor, fp``: the homes, or all anchors in reach, of every fingerprint and key."""
    every = keys(blocks, chosen)
    df = distinct.select("fp", F.array(*map(_key, every)).alias("keys"))
    parts = []
    for k, own in enumerate(every):
        key, base = F.col("keys")[k], F.lit(k << 33)
        s = _syndrome(key, code)
        if resident:
            home = key.bitwiseXOR(F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)).otherwise(F.lit(0).cast("long")))
            parts.append(home + base)
        else:
            masks = F.array(*(F.array(*(F.lit(x).cast("long") for x in m)) for m in visitor_masks(sum(w for _, w in own), code)))
            parts.append(F.transform(F.element_at(masks, s + 1), key.bitwiseXOR))
            parts[-1] = F.transform(parts[-1], base.__add__)
    at = F.array(*parts) if resident else F.flatten(F.array(*parts))
    return df.select(F.explode(at).alias("anchor"), F.lit(int(not resident)).cast("tinyint").alias("visitor"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, one less than nodes for each."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[move], nodes[label[move]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between residents and visitors of one cell; cells arrive in order, residents first."""
    home_cell, home = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        cell, visitor = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 0
        fp = batch.column(2).to_numpy().view(np.uint64)
        home_cell, home = np.r_[home_cell, cell[~visitor]], np.r_[home, fp[~visitor]]
        guest = fp[visitor]
        low = np.searchsorted(home_cell, cell[visitor], "left")
        n = np.searchsorted(home_cell, cell[visitor], "right") - low
        found = [(home[:0], home[:0])]
        step = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1, len(n)]
        for i, j in zip(step[:-1], step[1:], strict=True):
            m = n[i:j]
            who = np.repeat(guest[i:j], m)
            whom = home[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - low[i:j], m)]
            near = (np.bitwise_count(who ^ whom) <= MOST_BITS) & (whom != who)
            a, b = who[near], whom[near]
            found.append(_forest(a, b) if len(a) > LINKS else (a, b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a) > LINKS:
            a, b = _forest(a, b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        if len(cell):  # only the open cell's residents are wanted again
            home_cell, home = home_cell[keep := home_cell == cell[-1]], home[keep]


def links(distinct: DataFrame) -> DataFrame:
    """Links between different fingerprints, enough of them to connect all that are linked."""
    spark = distinct.sparkSession
    how = layout(distinct.count())
    residents, visitors = _anchors(distinct, True, *how), _anchors(distinct, False, *how)
    crowded = residents.groupBy("anchor").count().filter(F.col("count") > CROWD)
    crowded = checkpointed(crowded.select("anchor", F.ceil(F.col("count") / CROWD).cast("int").alias("slices")))
    if crowded.isEmpty():
        rows = residents.unionByName(visitors).withColumn("slice", F.lit(0))
    else:
        one = F.coalesce("slices", F.lit(1))
        r = residents.join(crowded, "anchor", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1)))
        v = visitors.join(crowded, "anchor", "left").withColumn("slice", F.pmod(F.xxhash64("fp"), one).cast("int"))
        rows = r.drop("slices").unionByName(v.drop("slices"))
    rows = rows.select((F.col("anchor") + F.shiftleft(F.col("slice").cast("long"), 38)).alias("cell"), "visitor", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell").sortWithinPartitions("cell", "visitor").mapInArrow(_compare, "a bigint, b bigint")


def _spread(prints: DataFrame, ids: DataFrame) -> DataFrame:
    """``prints`` with the component of their fingerprint.

    A fingerprint with more than its share of the rows would fill a task. Those with a
    quarter of a partition's share or more are at most four times as many as partitions,
    so they are broadcast; the others meet by shuffle.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = ids.agg(F.sum("n")).first()[0] or 0
    crowded = F.broadcast(ids.filter(F.col("n") * 4 * parts >= total).select("fp", "component_id"))
    rest = ids.filter(F.col("n") * 4 * parts < total).select("fp", "component_id")
    return prints.join(crowded, "fp").unionByName(prints.join(crowded, "fp", "left_anti").join(rest, "fp"))


def near_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; written to the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        prints = scratch.keep(fingerprints(docs, shingle))
        # The smallest doc_id of a fingerprint is combined before it is shuffled.
        distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
        with setting(spark, ROWS_SETTING, "65536"):  # rows of three numbers; all of it is written inside
            roots = connected(links(distinct.select("fp")))
        joined = roots.withColumnRenamed("node", "fp").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
        joined = checkpointed(joined.join(distinct, "fp"))
        groups = joined.groupBy("root").agg(F.min("least").alias("component_id"))
        linked = joined.select("fp", "root").join(groups, "root").select("fp", "component_id")
        ids = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
        return checkpointed(_spread(prints, scratch.keep(ids)).select("doc_id", "fp", "component_id"))
    finally:
        scratch.close()


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without those that another document of their component, with a smaller doc_id, stands for.

    Rows with a null doc_id stay.
    """
    gone = near_components(docs, shingle).filter("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
