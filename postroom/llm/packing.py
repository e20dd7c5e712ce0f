"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Method: large-item matching on the histogram of piece lengths. Pieces above a third of the
capacity go at most two to a sequence, the largest with the largest that still fits beside
it; smaller pieces, longest first, then go to the tightest gap that holds them. Lengths
are bounded by the capacity, so the histogram, the plan made from it and the table of
slots are bounded by the capacity too, whatever the number of documents; only they reach
the driver. Pieces find their slot by their rank among pieces of equal length, counted in
two levels (bucket, then row) so that no length has to fit one task.

Null and empty texts are one piece with the end id alone. Repeated rows are packed once
each. A lost executor costs its partitions: pieces are written to the shared folder before
ranks are taken, so a second attempt sees the same rows. Only the listed columns come out.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, checkpointed, table
from .token_counts import RankMerger

CAPACITY, END_ID = 2048, 0
#: Rows that share a length and are ranked by one task, about.
BUCKET_ROWS = 100_000
WORD = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Signs that str.split() takes for white space and the vocabulary's pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Stretches between white space that a worker remembers, and the longest that is worth it.
MEMO, MEMO_CHARS = 400_000, 32


class WordEncoder:
    """Ids of whole texts as little-endian bytes under a vocabulary of lower-case words.

    White space always ends a word, so a text is the chain of its stretches; each distinct
    stretch is merged once, all new ones of a batch together in one ragged array.
    """

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.memo: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """The text in normal form, cut at white space; special strings stand alone as they are."""
        out: list[str] = []
        for k, part in enumerate(self.special_re.split(text) if self.special_re else [text]):
            if k % 2:
                out.append(part)
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # lower() alone makes a final sigma
            out += WORD.findall(part) if ODD_SPACE.search(part) else part.split()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.stretches(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo.update(self.special)
        new = list(set().union(*split).difference(self.memo))
        words, n = [], []
        for x in new:
            if x.isalpha():
                words.append(x.encode("utf-8"))
                n.append(1)
            else:
                own = [w.encode("utf-8") for w in WORD.findall(x)]
                words += own
                n.append(len(own))
        seq, ids = self.merger.merge(words)
        owner = np.repeat(np.arange(len(new)), n)[seq]
        ends = (4 * np.searchsorted(owner, np.arange(len(new)), "right")).tolist()
        flat = ids.astype("<u4").tobytes()
        self.memo.update({x: flat[i:j] for x, i, j in zip(new, [0, *ends], ends, strict=False)})
        get = self.memo.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for x in new:
            if len(x) > MEMO_CHARS:
                del self.memo[x]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; no shuffle."""
    arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, copies in each), ...])."""
    left = {n: c for n, c in counts.items() if c}
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, count: int, content: list[tuple[int, int]]) -> None:
        if count:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((count, content))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        c = left[n]
        at = bisect_left(large, capacity - n + 1) - 1  # the largest partner that fits
        if at < 0 or (large[at] == n and c == 1 and at == 0):
            put(capacity - n, c, [(n, 1)])
            large.pop()
            continue
        if large[at] == n and c == 1:
            at -= 1
        m = large[at]
        pairs = c // 2 if m == n else min(c, left[m])
        put(capacity - n - m, pairs, [(n, 2)] if m == n else [(n, 1), (m, 1)])
        left[n] -= pairs
        left[m] -= pairs
        for x in {n, m}:
            if not left[x]:
                large.remove(x)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                q = capacity // n
                put(capacity - n * q, c // q, [(n, q)])
                put(capacity - n * (c % q), int(c % q > 0), [(n, c % q)])
                break
            gap = gaps[at]
            count, content = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            q = gap // n
            full, rest = (count, 0) if c >= q * count else divmod(c, q)
            put(gap - n * q, full, [*content, (n, q)])
            put(gap - n * rest, int(rest > 0), [*content, (n, rest)])
            put(gap, count - full - (rest > 0), content)
            c -= q * full + rest
    return [g for gap in gaps for g in groups[gap]]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, first offset) of every place."""
    out, used, base = [], {}, 0
    for count, content in groups:
        offset = 0
        for n, copies in content:
            at = used.get(n, 0)
            used[n] = at + count * copies
            out.append((n, at, used[n], base, copies, offset))
            offset += n * copies
        base += count
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with ``length``) and each row's ``sequence_id`` and ``offset``; read more than once."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(
        slots(pack_histogram(counts, capacity)), "length bigint, r_from bigint, r_to bigint, base bigint, copies bigint, first bigint"
    )
    n = max(16, sum(counts.values()) // BUCKET_ROWS)
    rows = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    before = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    # The slots are bounded by the capacity, not by the documents: a broadcast is safe.
    hit = (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & hit)
    at = F.col("rank") - F.col("r_from")
    return placed.select(
        *parts.columns,
        (F.col("base") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first") + F.pmod(at, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``; the result is written to the shared folder."""
    scratch = Scratch(docs.sparkSession)
    try:
        return checkpointed(pack(scratch.keep(pieces(docs, vocabulary, capacity)), capacity))
    finally:
        scratch.close()


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
