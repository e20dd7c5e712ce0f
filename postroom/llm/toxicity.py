"""Toxicity scores by compression distance.

Method: two zstandard dictionaries, trained apart by the library's own trainer, one on
ordinary and one on toxic text. A text falls into windows of two words; each
is compressed with either dictionary, behind the dictionary's own last ``LEAD`` bytes (one
match in both, so that even a short window is compressed, not stored as it is). The bytes
that the toxic dictionary saves are the window's gain, unless it still needs over ``DEAR``;
gains count from a zero set for each pair of dictionaries on ordinary texts unseen by both. Counts and shares of windows from
gain thresholds of 1 to 8 up, the largest gains and their mean, none beyond what the
calibration saw, go through a logistic calibration; a text without any gain scores the
share of toxic ones among such texts.

Toxic texts are mostly ordinary, so the toxic dictionary is trained in rounds: first on
whole toxic texts, then on those of their windows whose gain says toxic: from the least
threshold that ``CLEAR`` times the share of toxic texts' windows pass as of ordinary ones.
A text never judges itself: toxic texts are in two halves by hash, and each half's windows
are chosen, and its texts calibrated, with the other half's dictionary; the final one is
trained on both. Where too few windows are chosen to train on, the rounds end. Every ``RESERVED``-th ordinary text stays out of the ordinary dictionary;
thresholds and calibration are measured on those, at the classes' shares of the sample.

Fit: at most ``SAMPLE`` labelled documents outside the held-out remainder, those with the
smallest hash of doc_id, and of these as many as hold ``SAMPLE_BYTES``; whole texts, every
window of them. The dictionaries of whole texts are trained in tasks, one for each class
and half; to the driver come chosen windows of toxic texts and a few numbers for each row.
Labels, lang, source and doc_id are never inputs of a score.

Null texts count as empty; an empty text is one empty window and gets a score like any
other. Null labels are ignored; of contradictory ones the larger counts; of repeated rows
of one doc_id the least text. Words longer than ``WORD_BYTES`` count as several. Without both
classes, or with too little of one to train on, every score is 0.5 (predicted 0). Repeated
rows are scored once each; only the listed columns come out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, checkpointed, table
from .quality import labelled, logistic

SAMPLE, SAMPLE_BYTES = 8_000, 64_000_000
WORD_BYTES, LEAD = 32, 12
#: Bytes of a dictionary of ordinary text, of whole toxic texts, and of toxic windows.
ORDINARY, WHOLE, TOXIC = 400_000, 60_000, 16_000
ROUNDS, CLEAR = 3, 4
#: Ordinary texts, one in so many by hash, that thresholds and calibration are measured on.
RESERVED = 4
#: A window that costs more bytes than this with the toxic dictionary isn't toxic; its gain is 0.
DEAR = 9
TOP, NONE = 12, -12
#: Gains count from where at most this share of the windows of reserved ordinary texts goes further.
ABOVE = 0.04
#: Gains that a worker remembers (9 bytes each), words that it knows by number (some 120 bytes each), words looked up at once.
MEMORY, WORDS, AT_ONCE = 1 << 22, 800_000, 50_000
#: Places of the memory that a window may be at.
PLACES = 8
HALVES = ("even", "odd")
OTHER = dict(zip(HALVES, HALVES[::-1], strict=True))


def words(text: str | None) -> list[bytes]:
    """All words of a text in lower case, filled up with empty ones to whole windows."""
    out = (text or "").lower().encode("utf-8").split()
    if max(map(len, out), default=0) > WORD_BYTES:
        out = [w[i : i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out + [b""] * (len(out) % 2 if out else 2)


def window(first: bytes, second: bytes) -> bytes:
    return b" %b %b " % (first, second) if second else b" %b " % first


def windows(text: str | None) -> list[bytes]:
    """All windows of a text in lower case."""
    own = words(text)
    return list(map(window, own[::2], own[1::2]))


def shuffled(text: str) -> tuple[int, str]:
    """Key of an order that is always the same but puts no like texts together; the trainer takes segments from all parts."""
    return zlib.crc32(text.encode("utf-8")), text


def train(samples: list[bytes], size: int) -> bytes | None:
    """A zstandard dictionary of at most ``size`` bytes; None where there is too little to train on."""
    size = min(size, sum(map(len, samples)) // 2)
    try:
        return zs.train_dictionary(size, samples, k=128, d=8, f=20, accel=1, split_point=1.0, level=3).as_bytes()
    except zs.ZstdError:
        return None


class Coder:
    """Compressed sizes of windows, less that of the lead alone."""

    def __init__(self, dictionary: bytes):
        log = max(13, (len(dictionary) - 1).bit_length())  # tables that fit the dictionary
        how = zs.ZstdCompressionParameters.from_level(
            18, window_log=21, hash_log=log - 1, chain_log=log, min_match=3, search_log=5, target_length=16, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        ready = zs.ZstdCompressionDict(dictionary)
        ready.precompute_compress(compression_params=how)
        self.compress = zs.ZstdCompressor(compression_params=how, dict_data=ready).compress
        self.lead = dictionary[-LEAD:]
        self.least = len(self.compress(self.lead))

    def sizes(self, parts: list[bytes]) -> np.ndarray:
        compress, lead = self.compress, self.lead
        return np.array([len(compress(lead + w)) for w in parts], np.int64) - self.least


_READY: dict[bytes, Coder] = {}


def coder(dictionary: bytes) -> Coder:
    if dictionary not in _READY:
        while len(_READY) > 5:
            _READY.pop(next(iter(_READY)))
        _READY[dictionary] = Coder(dictionary)
    return _READY[dictionary]


class Numbers:
    """Numbers of words, from 1 up (0: the empty word); no number is given twice, words not met for long get a new one."""

    def __init__(self):
        self.new, self.old, self.next = {b"": 0}, {}, 1

    def of(self, text: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.new.get, text, repeat(-1)), np.int64, len(text))
        for i in np.flatnonzero(out < 0).tolist():
            word = text[i]
            number = self.new.get(word)
            if number is None:
                number = self.old.get(word)
                if number is None:
                    number, self.next = self.next, self.next + 1
                self.new[word] = number
            out[i] = number
        if len(self.new) > WORDS // 2:
            self.new, self.old = {b"": 0}, self.new
        return out


class Memory:
    """Small numbers by keys above 0, each at one of ``PLACES`` places from its hash on; where all are taken the new one displaces another."""

    def __init__(self, size: int):
        self.keys, self.values, self.shift = np.zeros(size + PLACES, np.uint64), np.zeros(size + PLACES, np.int8), np.uint64(65 - size.bit_length())

    def home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the indices of keys that aren't there."""
        out, todo, at = np.zeros(len(keys), np.int64), np.arange(len(keys)), self.home(keys)
        for _ in range(PLACES):
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo, at = todo[~hit], at[~hit] + 1
            if not len(todo):
                break
        return out, todo

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Of different keys that aren't there."""
        at = self.home(keys)
        last = at + (keys % np.uint64(PLACES)).astype(np.int64)
        for k in range(PLACES + 1):
            free = np.flatnonzero(self.keys[at] == 0) if k < PLACES else np.arange(len(keys))
            at = at if k < PLACES else last
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys  # of keys at one place one stays
            self.values[at[here]] = values[here]
            keys, values, at, last = keys[~here], values[~here], at[~here] + 1, last[~here]


class Scale:
    """Gains of windows by a pair of dictionaries; a memory saves compressing most windows that were met before.

    Windows are remembered by the numbers of their two words, so no two are ever taken for one.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.numbers, self.memory = coder(ordinary), coder(toxic), Numbers(), Memory(MEMORY)

    def gains(self, text: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of ``words``, ``NONE`` where it needs over ``DEAR``."""
        if self.numbers.next + len(text) >= 1 << 32:
            self.numbers, self.memory = Numbers(), Memory(MEMORY)
        pairs = self.numbers.of(text).astype(np.uint64).reshape(-1, 2)
        keys = (pairs[:, 0] << np.uint64(32) | pairs[:, 1]) + np.uint64(1)
        out, missing = self.memory.get(keys)
        if len(missing):
            new, first, same = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first].tolist()
            parts = list(map(window, map(text[::2].__getitem__, at), map(text[1::2].__getitem__, at)))
            cost = self.toxic.sizes(parts)
            near = np.flatnonzero(cost <= DEAR)
            gain = np.full(len(new), NONE, np.int64)
            gain[near] = self.ordinary.sizes([parts[i] for i in near]) - cost[near]
            self.memory.put(new, gain)
            out[missing] = gain[same]
        return out


_PAIRS: dict[tuple[bytes, bytes], Scale] = {}


def gains(text: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    if (ordinary, toxic) not in _PAIRS:
        while len(_PAIRS) > 1:
            _PAIRS.pop(next(iter(_PAIRS)))
        _PAIRS[ordinary, toxic] = Scale(ordinary, toxic)
    return _PAIRS[ordinary, toxic].gains(text)


def texts_gains(texts: list[str | None], ordinary: bytes, toxic: bytes) -> Iterator[np.ndarray]:
    """Gains of each text; those of short ones are looked up together."""
    some: list[bytes] = []
    ends: list[int] = []
    for k, text in enumerate(texts, 1):
        some += words(text)
        ends.append(len(some) // 2)
        if len(some) > AT_ONCE or k == len(texts):
            yield from np.split(gains(some, ordinary, toxic), ends[:-1])
            some, ends = [], []


def features(g: np.ndarray, zero: int) -> list[float]:
    """Of a text's gains above ``zero``."""
    g = np.sort(np.maximum(g - zero, 0))[::-1]
    over = np.searchsorted(-g, -np.arange(1, 9), "right")
    return [g[0], g[:3].mean(), g[:8].mean(), g.mean(), *(over / len(g)), *np.log1p(over), np.log(len(g))]


N_FEATURES = 21


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    zero: int
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    quiet: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(g, self.zero) for g in texts_gains(texts, self.ordinary, self.toxic)], float).reshape(-1, N_FEATURES)
        z = (np.clip(x, self.low, self.high) - self.mean) / self.spread
        s = 1 / (1 + np.exp(-np.clip((z * self.weights[:-1]).sum(axis=1) + self.weights[-1], -30, 30)))
        return np.where(x[:, 0] > 0, s, self.quiet)


def whole_text_dictionaries(sample: DataFrame) -> dict[str, bytes | None]:
    """By part of the sample: a dictionary of its whole texts, each trained in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [w for t in sorted(rows["text"], key=shuffled) for w in windows(t)]
        return pd.DataFrame({"part": [key[0]], "dictionary": [train(parts, ORDINARY if key[0] == "ordinary" else WHOLE)]})

    toxic = sample.filter(F.col("part").isin(*HALVES)).select(F.explode(F.array("part", F.lit("toxic"))).alias("part"), "text")
    rows = sample.select("part", "text").filter("part = 'ordinary'").unionByName(toxic).groupBy("part").applyInPandas(run, "part string, dictionary binary").collect()
    return {r["part"]: r["dictionary"] and bytes(r["dictionary"]) for r in rows}


def chosen_windows(rows: DataFrame, ordinary: bytes, toxic: dict[str, bytes]) -> dict[str, list[bytes]]:
    """Of each half's toxic texts the windows that the other half's dictionary finds toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts, of = batch.column("text").to_pylist(), batch.column("part").to_pylist()
            for half in HALVES:
                some = [k for k, part in enumerate(of) if part in (half, "reserved")]
                for k, g in zip(some, texts_gains([texts[k] for k in some], ordinary, toxic[OTHER[half]]), strict=True):
                    part, parts, g = of[k], windows(texts[k]) if of[k] == half else [], np.clip(g, 0, TOP)
                    hot = np.flatnonzero(g) if part == half else []
                    row = (half, np.bincount(g, minlength=TOP + 1).tolist(), [parts[i] for i in hot] if part == half else None, [int(g[i]) for i in hot])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["half", "counts", "hot", "gain"])

    got = rows.mapInArrow(run, "half string, counts array<bigint>, hot array<binary>, gain array<int>").collect()
    chosen = {}
    for half in HALVES:
        own = [r for r in got if r["half"] == half and r["hot"] is not None]
        other = [r for r in got if r["half"] == half and r["hot"] is None]
        share = []
        for side in (other, own):
            over = np.cumsum(np.sum([r["counts"] for r in side] or [[0] * (TOP + 1)], axis=0)[::-1])[::-1]
            share.append(over / max(1, over[0]))
        least = next((k for k in range(1, TOP) if share[1][k] >= CLEAR * share[0][k]), TOP)
        own.sort(key=lambda r: (zlib.crc32(b"".join(r["hot"])), r["hot"]))
        chosen[half] = [bytes(w) for r in own for w, g in zip(r["hot"], r["gain"], strict=True) if g >= least]
    return chosen


def zeros(rows: DataFrame, ordinary: bytes, toxic: dict[str, bytes]) -> dict[str, int]:
    """By name of a toxic dictionary: the gain that at most ``ABOVE`` of the reserved texts' windows go beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: np.zeros(TOP - NONE + 1, np.int64) for name in toxic}
        for batch in batches:
            for name, own in toxic.items():
                for g in texts_gains(batch.column("text").to_pylist(), ordinary, own):
                    counts[name] += np.bincount(np.clip(g, NONE, TOP) - NONE, minlength=TOP - NONE + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tolist() for c in counts.values()], pa.list_(pa.int64()))], ["name", "counts"])

    got = rows.filter("part = 'reserved'").mapInArrow(run, "name string, counts array<bigint>").collect()
    out = {}
    for name in toxic:
        counts = np.sum([r["counts"] for r in got if r["name"] == name], axis=0)
        beyond = counts.sum() - np.cumsum(counts)
        out[name] = NONE + int(np.argmax(beyond <= ABOVE * counts.sum()))
    return out


def calibration_rows(rows: DataFrame, ordinary: bytes, toxic: dict[str, bytes], zero: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of toxic texts by the other half's dictionary, of reserved ordinary ones, which trained none, by the final one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            texts, of = batch.column("text").to_pylist(), batch.column("part").to_pylist()
            for name in sorted(toxic):
                some = [t for t, part in zip(texts, of, strict=True) if name == ("final" if part == "reserved" else OTHER[part])]
                x += [features(g, zero[name]) for g in texts_gains(some, ordinary, toxic[name])]
                y += [int(name != "final")] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toArrow()
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, N_FEATURES), got.column("label").to_numpy().astype(int)
    order = np.lexsort((*x.T, y))  # sums in one order, however the rows arrive
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, modulus: int, held: int, bound: int = SAMPLE) -> Model | None:
    """None where the sample lacks a class or has too little of one."""
    spark = docs.sparkSession
    arrow_batches(spark)
    lots = F.pmod(F.xxhash64("text"), F.lit(2 * RESERVED))
    half = F.when(lots % 2 == 0, HALVES[0]).otherwise(HALVES[1])
    part = F.when(F.col("label") == 1, half).when(lots < 2, "reserved").otherwise("ordinary")
    rows = labelled(docs, labels, "toxic", modulus, held, bound, SAMPLE_BYTES).select("text", part.alias("part"))
    sample = checkpointed(rows.repartition(max(2, spark.sparkContext.defaultParallelism)))
    trained = whole_text_dictionaries(sample)
    ordinary, toxic = trained.get("ordinary"), {h: trained.get(h) for h in HALVES}
    if ordinary is None or None in toxic.values():
        return None
    rows, final = sample.filter("part <> 'ordinary'"), trained["toxic"]
    for _ in range(ROUNDS):
        chosen = chosen_windows(rows, ordinary, toxic)
        new = {h: train(c, TOXIC) for h, c in chosen.items()}
        both = train([w for c in chosen.values() for w in c], TOXIC)
        if both is None or None in new.values():
            break
        toxic, final = new, both
    toxic = {**toxic, "final": final}
    zero = zeros(rows, ordinary, toxic)
    x, y = calibration_rows(rows, ordinary, toxic, zero)
    if len(set(y)) < 2:
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = logistic((x - mean) / spread, y, ridge=1.0)
    n = {r["part"]: r["count"] for r in sample.groupBy("part").count().collect()}
    more = (n["reserved"] + n["ordinary"]) / n["reserved"]  # to the classes' shares of the sample
    weights[-1] -= np.log(more)
    silent = np.bincount(y[x[:, 0] == 0], minlength=2)
    quiet = (silent[1] + 0.5) / (silent[1] + more * silent[0] + 1)
    return Model(ordinary, final, zero["final"], x.min(axis=0), x.max(axis=0), mean, spread, weights, float(quiet))


def score_toxicity(docs: DataFrame, model: Model | None, modulus: int, held: int, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if model and texts:
                s = model.score(texts)
            else:
                s = np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()).cast(pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all their columns; no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if model and texts:
                s = model.score(texts)
                batch = batch.filter(pa.array(s < threshold, pa.bool_()))
            yield batch

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    return score_toxicity(docs, fit(docs, labels, modulus, held), modulus, held)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
