"""Exact substring deduplication over whole corpora.

Every byte goes that a ``length``-byte string covers which starts anywhere else too, in the
same document or another; strings never cross documents and are judged on the input.

Method: a logarithmic family of sparse suffix arrays. The suffixes kept are those at
minimisers: each ``length``-byte window is led by the leftmost of its least ``GRAM``-byte
hashes, so equal windows are led by equal grams at equal offsets. Windows with the same
leader form a run; a suffix entry holds the leader's hash, the hash of the run's whole
stretch, and its place. A batch of documents becomes an array sorted by these, dealt over
the cluster by leader, and is merge-scanned with the levels that exist: entries whose
stretch recurs are long matches, old and new alike. One entry for each different stretch
goes on to the next level, and two levels of equal size merge into one of twice the size.

Stretches that recur whole need no text. Where different stretches share a leader (edges
of a passage, edited copies), their bytes meet once at the leader's task, which compares
the windows in them; a leader with more than ``CROWD`` of them has its windows counted by
hash over the whole cluster instead. Equal stretches are combined before anything is
shuffled, so a passage of a third of all rows sends one entry a batch of rows, not one a
document. Where it stands between different neighbours, its edges are different stretches:
two a leader and batch go to the leader's task, which is enough to tell that they differ,
the others are dealt out by row and go straight to the comparison.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; repeated
rows are copies of each other and lose what they share; rows are told apart by two hashes
of doc_id and text, 96 bits in all (``rid``, ``salt``); columns other than those read play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, checkpointed, table

LENGTH, GRAM, BATCHES = 200, 40, 4
#: Different stretches with one leader that a task compares in memory; more go by their windows.
CROWD = 10_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
ENTRY = "leader bigint, stretch bigint, rid bigint, salt int, start int, n int, state tinyint"
#: What tells a row of documents from all others.
ROW = ["rid", "salt"]
#: States of an entry: seen once so far, known to recur (and marked), mark only, compare only; ``OLD`` more for entries of a level.
ONCE, AGAIN, MARK, SENT, OLD = 0, 1, 2, 3, 4
#: Different stretches of one leader that a batch of rows sends to the leader's task.
WITNESSES = 2


class _Powers:
    """Powers of the base and its inverse modulo 2**64, longer when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            n = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.r_[_U(1), np.cumprod(np.full(n - 1, _BASE, _U), dtype=_U)]
                self.down = np.r_[_U(1), np.cumprod(np.full(n - 1, inverse, _U), dtype=_U)]
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix(raw: bytes) -> np.ndarray:
    """Sums of which the hash of any stretch is a difference."""
    up, _ = _POWERS.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        return np.r_[_U(0), np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * up[: len(raw)], dtype=_U)]


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * down[start] + _U(0x1234567) * (end - start).astype(_U))


def leaders(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least gram in each window of ``width`` grams."""
    n = len(grams)
    pad = -n % width
    key = np.r_[grams, np.full(pad, ~_U(0), _U)].reshape(-1, width)
    before = np.minimum.accumulate(key, axis=1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    # The leftmost place of that value: the next place, from the window's start, where it stands.
    order = np.argsort(grams, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    value = grams[order]
    first = np.searchsorted(value, least, "left")
    starts = np.arange(len(least))
    place = order[first]
    late = np.flatnonzero(place < starts)  # earlier twins of the value: few, step past them
    while len(late):
        first[late] += 1
        place[late] = order[first[late]]
        late = late[place[late] < late]
    return place


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leader, stretch, start, n) of every run of windows of one document."""
    n = len(raw)
    if n < length:
        return (np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))
    sums = prefix(raw)
    at = np.arange(n - gram + 1)
    grams = stretch_hash(sums, at, at + gram)
    place = leaders(grams, length - gram + 1)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size = np.diff(np.r_[start, len(place)])
    return grams[place[start]], stretch_hash(sums, start, start + size + length - 1), start, size


def _batch(leader, stretch, rid, salt, start, n, state) -> pa.RecordBatch:
    cols = [pa.array(leader.astype(_U).view(np.int64)), pa.array(stretch.astype(_U).view(np.int64)), pa.array(rid.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(state.astype(np.int8))]
    return pa.RecordBatch.from_arrays(cols, ["leader", "stretch", "rid", "salt", "start", "n", "state"])


def _entries(length: int, gram: int):
    """Suffix entries of documents (rid, salt, text; without salt it is 0); equal stretches of a batch become one entry and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner, salts = [], [], []
            rids = batch.column("rid").to_pylist()
            other = batch.column("salt").to_pylist() if "salt" in batch.schema.names else [0] * len(rids)
            for rid, more, text in zip(rids, other, batch.column("text").to_pylist(), strict=True):
                own = runs((text or "").encode("utf-8"), length, gram)
                found.append(own)
                owner.append(np.full(len(own[0]), rid, np.int64))
                salts.append(np.full(len(own[0]), more, np.int32))
            if not found:
                continue
            leader, stretch, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
            rid, salt = np.concatenate(owner), np.concatenate(salts)
            order = np.lexsort((stretch, leader))
            leader, stretch, start, n, rid, salt = (x[order] for x in (leader, stretch, start, n, rid, salt))
            new = np.r_[True, (leader[1:] != leader[:-1]) | (stretch[1:] != stretch[:-1])][: len(leader)]
            twin = ~new | np.r_[~new[1:], np.zeros(min(1, len(new)), bool)]
            state = np.where(twin, np.where(new, AGAIN, MARK), ONCE)
            # A first entry that recurs is marked by a row of its own; marks are dealt by row, not by leader.
            both = np.flatnonzero(state == AGAIN)
            mark = np.r_[both, np.flatnonzero(state == MARK)]
            keep = np.flatnonzero(new)
            at = np.arange(len(keep))
            top = np.r_[True, leader[keep][1:] != leader[keep][:-1]][: len(keep)]
            rank = at - np.maximum.accumulate(np.where(top, at, 0))
            # Leaders with more stretches than witnesses: the rest is dealt by row, the leader in place of the stretch.
            sent, keep = keep[rank >= WITNESSES], keep[rank < WITNESSES]
            yield _batch(leader[keep], stretch[keep], rid[keep], salt[keep], start[keep], n[keep], state[keep])
            yield _batch(mixed(rid[sent].view(_U) ^ start[sent].astype(_U)), leader[sent], rid[sent], salt[sent], start[sent], n[sent], np.full(len(sent), SENT))
            yield _batch(mixed(rid[mark].view(_U)), stretch[mark], rid[mark], salt[mark], start[mark], n[mark], np.full(len(mark), MARK))

    return run


#: What the merge-scan says of an entry: mark its stretch, compare its windows, keep it in the level.
FOUND = "what tinyint, " + ENTRY
TO_MARK, TO_COMPARE, TO_KEEP = 0, 1, 2


def _scan(keep_level: bool):
    """Merge-scan of entries sorted by leader, then stretch."""

    def out(what: int, rows: np.ndarray, state: np.ndarray | None = None) -> pa.RecordBatch:
        b = _batch(*(rows[k] for k in ("leader", "stretch", "rid", "salt", "start", "n")), rows["state"] if state is None else state)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), what, np.int8)), *b.columns], ["what", *b.schema.names])

    kind = np.dtype([("leader", _U), ("stretch", _U), ("rid", np.int64), ("salt", np.int64), ("start", np.int64), ("n", np.int64), ("state", np.int64)])

    def settle(rows: np.ndarray, earlier: bool, more: bool) -> Iterator[pa.RecordBatch]:
        """Whole stretches. ``earlier`` / ``more``: the first / last leader has another stretch outside ``rows``."""
        if not len(rows):
            return
        lead, st = rows["leader"], rows["stretch"]
        new = np.r_[True, (lead[1:] != lead[:-1]) | (st[1:] != st[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(rows)])
        recurs = (size > 1) | (np.add.reduceat(rows["state"] % OLD == AGAIN, first) > 0)
        # Leaders with more than one stretch.
        top = lead[first]
        several = np.r_[earlier, top[1:] == top[:-1]] | np.r_[top[:-1] == top[1:], more]
        yield out(TO_MARK, rows[recurs[group] & (rows["state"] % OLD == ONCE)])
        yield out(TO_COMPARE, rows[first[several]])
        if keep_level:  # what no level has yet; levels stay as written, a match found twice marks the same bytes
            fresh = np.maximum.reduceat(rows["state"], first) < OLD
            yield out(TO_KEEP, rows[first[fresh]], np.where(recurs, AGAIN, ONCE)[fresh])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows, earlier = np.empty(0, kind), False
        for batch in batches:
            rows = np.empty(len(batch), kind)
            for k, name in enumerate(("leader", "stretch", "rid", "salt", "start", "n", "state")):
                col = batch.column(k).to_numpy()
                rows[name] = col.view(_U) if k < 2 else col
            marks, sent = rows["state"] == MARK, rows[rows["state"] == SENT]
            if marks.any() or len(sent):
                yield out(TO_MARK, rows[marks])
                rows = rows[~marks & (rows["state"] != SENT)]
                sent["leader"] = sent["stretch"]
                yield out(TO_COMPARE, sent)
            rows = np.r_[open_rows, rows]
            if not len(rows):
                continue
            last = (rows["leader"] == rows["leader"][-1]) & (rows["stretch"] == rows["stretch"][-1])
            done = rows[~last]
            same = len(done) > 0 and done["leader"][-1] == rows["leader"][-1]
            yield from settle(done, earlier, same)
            if len(done):
                earlier = bool(same)
            open_rows = rows[last]
            if len(open_rows) > 1:  # known to recur: mark all, keep one
                yield out(TO_MARK, open_rows[open_rows["state"] % OLD == ONCE])
                old = OLD * (open_rows["state"].max() >= OLD)
                open_rows = open_rows[:1].copy()
                open_rows["state"] = AGAIN + old
        yield from settle(open_rows, earlier, False)

    return run


def _windows(length: int):
    """Bytes of the stretches to compare: (rid, salt, text, places) to (leader, rid, salt, start, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leader, rid, salt, start, raws = [], [], [], [], []
            for r, more, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8")
                for p in places:
                    leader.append(p["leader"])
                    rid.append(r)
                    salt.append(more)
                    start.append(p["start"])
                    raws.append(raw[p["start"] : p["start"] + p["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(leader, pa.int64()), pa.array(rid, pa.int64()), pa.array(salt, pa.int32()), pa.array(start, pa.int32()), pa.array(raws, pa.binary())], ["leader", "rid", "salt", "start", "raw"])

    return run


def _hashed(length: int):
    """The same places to (window hash, rid, salt, start), a row for every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, more, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = prefix((text or "").encode("utf-8"))
                n = np.array([p["n"] for p in places])
                at = np.repeat([p["start"] for p in places], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lead = np.repeat(np.array([p["leader"] for p in places], np.int64), n)
                h = stretch_hash(sums, at, at + length) ^ mixed(lead.view(_U))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), r, np.int64)), pa.array(np.full(len(h), more, np.int32)), pa.array(at.astype(np.int32))], ["h", "rid", "salt", "start"])

    return run


def _compare(length: int):
    """Windows of stretches with one leader that occur in more than one of them."""

    def group(lead: np.ndarray, rid: np.ndarray, salt: np.ndarray, start: np.ndarray, raws: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in raws])
        sums = prefix(b"".join(raws))
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(raws)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = inside + (np.cumsum(sizes) - sizes)[owner]
        h = stretch_hash(sums, at, at + length) ^ mixed(lead[owner].view(_U))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[back] > 1)
        new = np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])][: len(hit)]
        first = hit[new]
        size = np.diff(np.r_[np.flatnonzero(new), len(hit)])
        who = owner[first]
        return pa.RecordBatch.from_arrays([pa.array(rid[who]), pa.array(salt[who]), pa.array((start[who] + inside[first]).astype(np.int32)), pa.array(size.astype(np.int32))], ["rid", "salt", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            lead = rows.column("leader").to_numpy()
            cut = int(np.searchsorted(lead, lead[-1], "left")) if len(lead) else 0
            if cut:
                part = rows.slice(0, cut)
                yield group(lead[:cut], part.column("rid").to_numpy(), part.column("salt").to_numpy(), part.column("start").to_numpy(), part.column("raw").to_pylist())
            held = rows.slice(cut)
        if held is not None and len(held):
            yield group(*(held.column(k).to_numpy() for k in ("leader", "rid", "salt", "start")), held.column("raw").to_pylist())

    return run


class IndexFamily:
    """Levels of suffix entries; each holds one entry for every different stretch of its batches."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.length, self.gram = spark, length, gram
        self.scratch = Scratch(spark)
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, entries), largest first
        self.found: list[DataFrame] = []
        self.merges = 0

    def _scanned(self, rows: DataFrame, keep_level: bool) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(n, "leader").sortWithinPartitions("leader", "stretch")
        return dealt.mapInArrow(_scan(keep_level), FOUND)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Match a batch (rid, salt, text) with itself and all levels, and take it in unless it is the last."""
        arrow_batches(self.spark)
        rows = docs.select(*ROW, "text").mapInArrow(_entries(self.length, self.gram), ENTRY)
        for _, level in self.levels:
            rows = rows.unionByName(level.withColumn("state", (F.col("state") + OLD).cast("tinyint")))
        out = self.scratch.keep(self._scanned(rows, not last))
        self.found.append(out.filter(F.col("what") < TO_KEEP))
        if last:
            return
        size, level = 1, out.filter(F.col("what") == TO_KEEP).drop("what")
        while self.levels and self.levels[-1][0] == size:  # equal sizes merge, as a counter carries
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            both = self.levels.pop()[1].unionByName(level)
            self.merges += 1
            size, level = 2 * size, self.scratch.keep(both.repartition(n, "leader").sortWithinPartitions("leader", "stretch"))
        self.levels.append((size, level))

    def marks(self, docs: DataFrame) -> DataFrame:
        """``rid, salt, start, n``: runs of windows of ``docs`` (all batches) that occur elsewhere."""
        found = self.found[0]
        for more in self.found[1:]:
            found = found.unionByName(more)
        compare = found.filter(F.col("what") == TO_COMPARE).select("leader", *ROW, "start", "n").distinct()
        crowded = compare.groupBy("leader").count().filter(F.col("count") > CROWD).select("leader")
        crowded = checkpointed(crowded)
        texts = docs.select(*ROW, "text").dropDuplicates(ROW)

        def with_text(entries: DataFrame) -> DataFrame:
            places = entries.groupBy(*ROW).agg(F.collect_list(F.struct("leader", "start", "n")).alias("places"))
            return texts.join(places, ROW).select(*ROW, "text", "places")

        arrow_batches(self.spark)
        marks = found.filter(F.col("what") == TO_MARK).select(*ROW, "start", "n")
        if not crowded.isEmpty():
            rows = with_text(compare.join(crowded, "leader", "left_semi")).mapInArrow(_hashed(self.length), "h bigint, rid bigint, salt int, start int")
            rows = self.scratch.keep(rows)
            twice = rows.groupBy("h").count().filter("count > 1").select("h")
            marks = marks.unionByName(rows.join(twice, "h", "left_semi").select(*ROW, "start", F.lit(1).alias("n")))
            compare = compare.join(crowded, "leader", "left_anti")
        raw = with_text(compare).mapInArrow(_windows(self.length), "leader bigint, rid bigint, salt int, start int, raw binary")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shared = raw.repartition(n, "leader").sortWithinPartitions("leader").mapInArrow(_compare(self.length), "rid bigint, salt int, start int, n int")
        return marks.unionByName(self.scratch.keep(shared))

    def close(self) -> None:
        self.scratch.close()


def cut(docs: DataFrame, marks: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text (what is left), n_bytes, n_removed, n_spans, kept_sha256 of ``docs`` (rid, salt, doc_id, text)."""
    # Copies of a row, and an entry found again by a later batch, mark the same places.
    places = marks.distinct().groupBy(*ROW).agg(F.collect_list(F.struct("start", "n")).alias("places"))
    both = docs.select(*ROW, "doc_id", "text").join(places, ROW, "left").select("doc_id", "text", "places")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, left, at, spans = (text or "").encode("utf-8"), [], 0, 0
                for start, end in sorted((p["start"], p["start"] + p["n"] + length - 1) for p in places or ()):
                    if start > at or not spans:
                        left.append(raw[at:start])
                        spans += 1
                    at = max(at, end)
                left = b"".join([*left, raw[at:]])
                out.append((left, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """What ``cut`` gives for all ``docs``, indexed in ``batches``; with ``digest``, without the bytes kept, as a written table."""
    spark = docs.sparkSession
    row = ["doc_id", F.coalesce("text", F.lit(""))]
    own = docs.select("doc_id", "text", F.xxhash64(*row).alias("rid"), F.hash(*row).alias("salt"))
    family = IndexFamily(spark, length, gram)
    try:
        for k in range(batches):
            family.add(own.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == k), last=k == batches - 1)
        out = cut(own, family.marks(own), length)
        return checkpointed(out.drop("kept") if digest else out)
    finally:
        family.close()


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
