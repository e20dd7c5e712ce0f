"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class is a Gaussian over transformed statistics of the whole text (shares by square
root, counts by logarithm, clipped to the range of the training rows and standardised).
A class covariance is shrunk towards the pooled one and then towards its own diagonal; its
Cholesky factor is computed once, cached in the model and sent with it to the executors.
The score is the logistic of the difference of the two Mahalanobis log densities, with a
scale and an offset fitted on the same rows.

Fit: at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id, outside the
held-out remainder; they and nothing else reach the driver. Labels, lang, source and
doc_id are never inputs of a score. Null texts count as empty; empty texts get a score
like any other. Null or contradictory labels of a document: nulls are ignored, the larger
counts. With rows of one class only, or none, every score is that class's share (0.5).
Repeated rows are scored once each; only the listed columns come out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, checkpointed, table

#: Most labelled rows that the fit uses.
SAMPLE = 20_000
#: Most bytes of texts that a fit reads.
SAMPLE_BYTES = 256_000_000
POOLED, DIAGONAL = 0.3, 0.05
_KINDS = np.zeros((256, 6))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:'\"()-", bytes(range(128, 256)))):
    _KINDS[list(_chars), _k] = 1
NAMES = ["words", "word_chars", "upper", "digits", "symbols", "marks", "points", "high_bytes", "distinct", "pairs", "stutter", "lines_again", "commonest", "per_line"]


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of ``NAMES``."""
    raw = (text or "").encode("utf-8")
    words, n = raw.split(), max(1, len(raw))
    shares = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n)
    m = max(1, len(words))
    lines = raw.split(b"\n")
    common = Counter(words).most_common(1)[0][1] if words else 0
    return [
        math.log1p(len(words)),
        math.log1p((len(raw) - len(words)) / m),
        *shares.tolist(),
        math.sqrt(len(set(words)) / m),
        math.sqrt(len(set(zip(words, words[1:], strict=False))) / m),
        math.sqrt(sum(map(eq, words, words[1:])) / m),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(common / m),
        math.log1p(len(words) / len(lines)),
    ]


def forward(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The lower triangular ``factor`` divided out of each column of ``rows``.

    Plain array steps, here and in ``gram``: threaded BLAS calls on long thin arrays stall
    beside a JVM in one process.
    """
    out = np.array(rows, float)
    for i in range(len(factor)):
        for j in range(i):
            out[i] -= factor[i, j] * out[j]
        out[i] /= factor[i, i]
    return out


def gram(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of products of the columns of ``x``."""
    return np.einsum("ni,nj->ij", x if weights is None else x * weights[:, None], x)


@dataclass
class Discriminant:
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    scale: float
    offset: float

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (np.clip(x, self.low, self.high) - self.mean) / self.spread
        out = []
        for centre, factor in zip(self.centres, self.factors, strict=True):
            y = forward(factor, (z - centre).T)
            out.append(-0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.sign(g := self.gap(x)) * np.log1p(np.abs(g)) + self.offset, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the offset last, by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((a * w).sum(axis=1), -30, 30)))
        h = gram(a, p * (1 - p)) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, (a * (y - p)[:, None]).sum(axis=0) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | None:
    """None where either class has fewer than two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    low, high = np.quantile(x, 0.002, axis=0), np.quantile(x, 0.998, axis=0)
    z = np.clip(x, low, high)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-3
    z = (z - mean) / spread
    groups = [z[y == k] for k in (0, 1)]
    covs = [gram(g - g.mean(axis=0)) / (len(g) - 1) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(z)
    factors = []
    for c in covs:
        c = (1 - POOLED) * c + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 1e-2 * np.eye(len(c))
        factors.append(np.linalg.cholesky(c))
    model = Discriminant(low, high, mean, spread, [g.mean(axis=0) for g in groups], factors, 1.0, 0.0)
    g = model.gap(x)
    w = logistic((np.sign(g) * np.log1p(np.abs(g)))[:, None], y)
    model.scale, model.offset = float(max(w[0], 1e-6)), float(w[1])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents outside the held-out remainder.

    One row a doc_id, that with the least text; in the order of the ids' hashes, as many
    whole texts as hold ``most_bytes``.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held
    ids = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & rest).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` rows of two numbers: a broadcast is safe.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = checkpointed(rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label")))
    # The running sum passes one task: at most ``bound`` rows, and the sort there holds no texts.
    sizes = rows.select("doc_id", F.octet_length("text").alias("n"))
    fits = sizes.select("doc_id", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).filter(F.col("upto") <= most_bytes)
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi")


def sampled_statistics(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return x, got.column("label").to_numpy().astype(int)


def score_quality(docs: DataFrame, model: Discriminant | None, modulus: int, held: int, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()], float).reshape(-1, len(NAMES))
            s = model.score(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()).cast(pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    arrow_batches(docs.sparkSession)
    model = fit(*sampled_statistics(labelled(docs, labels, "quality", modulus, held)))
    return score_quality(docs, model, modulus, held)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
