"""Token counts of whole texts under a byte-level BPE vocabulary.

Method: rank-synchronous array merging. Distinct pre-tokens of a batch that have not been
seen before lie end to end in one ragged numpy array of symbol ids. In each round every
sequence applies the pair of lowest rank that it holds, at all its places, and all
sequences do so at the same time; sequences without a known pair leave the array. What
survives is counted. A merged symbol can only take part in pairs of higher rank than its
own, so a round per rank gives what a priority queue gives.

Null and empty texts have 0 tokens. Special strings of the vocabulary inside a text count
as one token each, the library's default. Ties (the same pair overlapping itself) merge
from the left. Output has the listed columns only, so other input columns can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table

#: The byte-level pre-tokenizer: contractions, letters, numbers, other signs, white space.
SPLIT = regex.compile(
    r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens remembered by a worker, and the longest that is worth it.
MEMO, MEMO_CHARS = 1_000_000, 48
NO_RANK = np.int64(1) << 40
#: Ids of single bytes, with and without an end of word, are below this.
SMALL = 512


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class RankMerger:
    """Counts BPE symbols of many byte strings at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = np.int64(len(vocab) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = [c for _, c in sorted(byte_alphabet().items())]
        self.first = np.array([vocab[c] for c in letters], np.int64)
        end = spec["model"].get("end_of_word_suffix")
        self.last = np.array([vocab[c + end] for c in letters], np.int64) if end else self.first
        side = np.arange(SMALL, dtype=np.int64)
        self.small = self._rank(np.repeat(side, SMALL), np.tile(side, SMALL))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memo: dict[str, int] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those of single bytes come from a table."""
        out = np.empty(len(a), np.int64)
        low = (a < SMALL) & (b < SMALL)
        out[low] = self.small[a[low] * SMALL + b[low]]
        out[~low] = self._rank(a[~low], b[~low])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word."""
        return np.bincount(self.merge(words)[0], minlength=len(words))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, ascending, and the ids of the symbols that survive in them."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        seq = np.repeat(np.arange(len(words)), sizes)
        sym = self.first[raw]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.last[raw[ends]]
        out: list[tuple[np.ndarray, np.ndarray]] = [(seq[:0], sym[:0])]
        rank = np.full(len(sym), NO_RANK)
        pair = np.flatnonzero(seq[1:] == seq[:-1])
        rank[pair] = self.rank_of(sym[pair], sym[pair + 1])
        while len(sym):
            same = seq[1:] == seq[:-1]
            starts = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            done = least == NO_RANK
            lowest = np.repeat(least, counts)
            hit = np.flatnonzero((rank == lowest) & (lowest < NO_RANK))
            if len(hit):  # a pair that overlaps itself merges from the left
                head = np.r_[True, np.diff(hit) != 1]
                since = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[since % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            over = np.repeat(done, counts)
            out.append((seq[over], sym[over]))
            stay = ~over
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            # Only pairs that a merged symbol is part of have another rank now.
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            moved = np.flatnonzero(near)
            rank[moved] = NO_RANK
            pair = moved[moved + 1 < len(sym)]
            pair = pair[seq[pair] == seq[pair + 1]]
            rank[pair] = self.rank_of(sym[pair], sym[pair + 1])
        seq, sym = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(seq, kind="stable")
        return seq[order], sym[order]

    def texts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text."""
        split, extra = [], []
        for text in texts:
            parts = self.special_re.split(text) if text and self.special_re else [text or ""]
            extra.append(len(parts) - 1)
            split.append([w for p in parts for w in SPLIT.findall(p)] if len(parts) > 1 else SPLIT.findall(parts[0]))
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*split).difference(self.memo))
        if new:
            counts = self.count([w.encode("utf-8") for w in new]).tolist()
            self.memo.update(zip(new, counts, strict=True))
        get = self.memo.__getitem__
        out = [x + sum(map(get, words)) for x, words in zip(extra, split, strict=True)]
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return out


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """The worker's merger for a vocabulary file, made once."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; no shuffle.

    A lost executor costs only its partitions, which are recounted from the scan.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = count.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
