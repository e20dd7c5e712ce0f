"""Benchmark decontamination: documents that hold a test item, up to an edit budget.

Item and document are compared in lower case with white space made single spaces. An item
of n characters has a budget of ``RATE`` n edits, at most so many that its pieces keep
``LEAST_PIECE`` characters.

Method: pigeonhole edit matching. Each item is cut into budget-plus-one pieces; whatever
holds it within budget holds one piece unchanged. All pieces of a block of items make one
Aho-Corasick automaton that runs over the whole text; each exact hit gives a window where
the item would lie, overlapping windows of an item merge, and Myers' bit-parallel distance
(one big integer for the whole item) decides.

The items are the stated query set. They are sent to the executors in blocks of at most
``BLOCK_CHARS`` characters, all documents passing each block, so any number of them will
do. Nothing is shuffled.

Defined results: null or empty items and texts match nothing; items shorter than
``LEAST_PIECE`` are matched exactly; repeated items or documents give a row each; extra
columns, whatever their names, pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches, table

RATE, LEAST_PIECE = 0.08, 12
#: Characters of items in one automaton (about 100 bytes of memory each).
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = RATE) -> int:
    return max(0, min(int(rate * n), n // LEAST_PIECE - 1))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of budget-plus-one pieces that differ by one character in length at most."""
    k = budget(len(item), rate) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _columns(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def _run(peq: dict[str, int], m: int, text: str, anchored: int) -> Iterator[int]:
    """Distance of the pattern to the best stretch that ends at each character; it starts at the first one if anchored."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        yield score


def best_match(item: str, peq: dict[str, int], text: str, limit: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the first best stretch within ``limit``."""
    least, end = limit + 1, -1
    for k, score in enumerate(_run(peq, len(item), text, 0)):
        if score < least:
            least, end = score, k
    if end < 0:
        return None
    back = text[max(0, end + 1 - len(item) - limit) : end + 1][::-1]
    for k, score in enumerate(_run(_columns(item[::-1]), len(item), back, 1)):
        if score == least:
            return least, end - k, end + 1
    return least, 0, end + 1


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[str], rate: float):
        self.items = items
        self.limits = [budget(len(x), rate) for x in items]
        self.peq = [_columns(x) for x in items]
        where = defaultdict(list)
        for k, item in enumerate(items):
            for offset, piece in pieces(item, rate) if item else []:
                where[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        found: dict[int, list[int]] = defaultdict(list)
        for end, (n, at) in self.automaton.iter(text) if len(self.automaton) else ():
            for k, offset in at:
                found[k].append(end + 1 - n - offset)
        out = {}
        for k, starts in found.items():
            n, slack = len(self.items[k]), self.limits[k]
            spans: list[list[int]] = []
            for s in sorted(set(starts)):
                a, b = max(0, s - slack), min(len(text), s + n + slack)
                if spans and a <= spans[-1][1] - n // 2:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            out[k] = spans
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, begin, end), the best place of each item that the text holds."""
        out = []
        for k, spans in self.windows(text).items():
            best = None
            for a, b in spans:
                hit = best_match(self.items[k], self.peq[k], text[a:b], self.limits[k])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], hit[1] + a, hit[2] + a)
            if best:
                out.append((k, *best))
        return sorted(out)


_READY: dict[int, Matcher] = {}


def _matcher(number: int, items: list[str], rate: float) -> Matcher:
    if number not in _READY:
        _READY.clear()
        _READY[number] = Matcher(items, rate)
    return _READY[number]


def blocks(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The items in blocks that hold ``BLOCK_CHARS`` characters or few more; copies of a text under other ids spread out."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // BLOCK_CHARS)
    for k in range(n):
        yield benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)


def _collect(block: DataFrame) -> tuple[list, list[str]]:
    rows = block.select("item_id", "text").collect()  # bounded by the block
    return [r[0] for r in rows], [normal(r[1]) for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, budget, begin, end``: a row for each item that a document holds.

    ``begin`` and ``end`` count characters of the text in the compared form.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    id_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_kind.simpleString()}, item_id {item_kind.simpleString()}, distance int, budget int, begin int, end int"
    item_type = to_arrow_type(item_kind)
    out = None
    for block in blocks(benchmark):
        ids, items = _collect(block)
        sent = spark.sparkContext.broadcast((ids, items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, items = sent.value
            matcher = _matcher(id(items), items, rate)
            for batch in batches:
                row, hits = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = matcher.matches(normal(text))
                    row += [k] * len(own)
                    hits += own
                cols = [batch.column(0).take(pa.array(row, pa.int64()))]
                cols.append(pa.array([ids[h[0]] for h in hits], item_type))
                cols += [pa.array(x, pa.int32()) for x in ([h[1] for h in hits], [matcher.limits[h[0]] for h in hits], [h[2] for h in hits], [h[3] for h in hits])]
                if hits:
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "distance", "budget", "begin", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns."""
    spark = docs.sparkSession
    arrow_batches(spark)
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(_collect(block)[1])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            matcher = _matcher(id(items), items, rate)
            for batch in batches:
                clean = [not matcher.matches(normal(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
