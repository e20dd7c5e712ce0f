"""Quality rules: document statistics and a learned decision list, DataFrame functions alone.

Statistics are array expressions over the whole text; nothing is exploded or shuffled.
Repeated five-word windows are found by hashing words, then windows, and looking for equal
neighbours among the sorted hashes; a text without a repeated hash skips that part.

Method: sequential covering. From the statistics of labelled rows that pass the base
rules, a rule grows by the threshold that gains most information about the reject class
until no kept row meets it, is pruned back on rows it has not seen, and enters the list if
it stays precise there; the rows it covers leave, and the next rule grows. The list becomes
one ordered CASE expression, so the verdict of a row is the first rule it meets, or keep.

Fit: at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id; their
statistics, a few numbers each, are all that reaches the driver; of rows with one doc_id,
that with the least text. Null texts have no words
and fail the base rules, like empty ones. Null labels are ignored; of contradictory ones
the larger counts. Without labels of both classes the list is empty and the base rules
decide alone. Repeated rows get the same verdict each; only the listed columns come out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 20_000
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
MOST_RULES, MOST_TERMS, LEAST_COVER, LEAST_PRECISION, CUTS = 12, 4, 3, 0.9, 60


def held(value: Column) -> Column:
    """``value``, kept by the optimiser in a projection of its own.

    Filters on a column made from nested lambdas would otherwise be pushed below the
    projections and compute every array anew for each of its elements.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the statistics; array columns are dropped again."""
    t = F.coalesce(F.col("text"), F.lit(""))
    left = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", "")).cast("long")
    df = docs.withColumns(
        {
            "__words": held(F.filter(F.split(t, "[\\x09-\\x0D ]+", -1), lambda w: w != "")),
            "__lines": held(F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x09-\\x0D ]"))),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": left("#*$%&|<>"),
            "n_upper": left("A-Z"),
            "n_marks": left("!?"),
            "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": held(F.transform("__words", lambda w: F.xxhash64(w))),
        }
    )
    parts = ", ".join(f"get(__hashes, i + {k})" for k in range(WINDOW))
    df = df.withColumn(
        "__grams",
        held(F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({parts})) ELSE array() END")),
    )
    df = df.withColumn(
        "__sorted",
        held(F.expr("CASE WHEN size(array_distinct(__grams)) < size(__grams) THEN sort_array(transform(__grams, (g, i) -> struct(g, i))) END")),
    )
    df = df.withColumn(
        "__again",
        held(
            F.expr(
                "sort_array(filter(transform(__sorted, (x, k) -> CASE WHEN x.g = get(__sorted, k - 1).g OR x.g = get(__sorted, k + 1).g THEN x.i END), i -> i IS NOT NULL))"
            )
        ),
    )
    covered = F.expr(f"aggregate(__again, struct(-{WINDOW} AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n)")
    df = df.withColumn("n_repeat_words", held(F.coalesce(covered, F.lit(0)).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__words", "__lines", "__hashes", "__grams", "__sorted", "__again")


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<='} {self.cut!r}D"

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.cut if self.at_least else v <= self.cut


def _covers(rule: list[Term], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for term in rule:
        out &= term.holds(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Term]:
    rule: list[Term] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_TERMS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            v = x[:, k]
            cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, CUTS)))
            for cut in cuts:
                for up in (True, False):
                    m = inside & (v >= cut if up else v <= cut)
                    p1, n1 = (m & bad).sum(), (m & ~bad).sum()
                    if p1 >= LEAST_COVER:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Term(name, up, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def _worth(rule: list[Term], x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    m = _covers(rule, x, names)
    p, n = (m & bad).sum(), (m & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, keep: np.ndarray, names: list[str]) -> list[list[Term]]:
    """Rules in order, each a conjunction that rejects; every third row prunes."""
    rules: list[list[Term]] = []
    bad = keep == 0
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (left & bad & ~prune).sum() >= LEAST_COVER:
        g, h = left & ~prune, left & prune
        rule = _grow(x[g], bad[g], names)
        if not rule:
            break
        while len(rule) > 1 and _worth(rule[:-1], x[h], bad[h], names) >= _worth(rule, x[h], bad[h], names):
            rule = rule[:-1]
        m = _covers(rule, x, names)
        if (m & h & bad).sum() < LEAST_PRECISION * (m & h).sum() or not (m & h).any():
            break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[list[Term]]) -> Column:
    """Number of the first rule a row meets, from 1; 0 for none."""
    if not rules:
        return F.lit(0)
    cases = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN {k}" for k, rule in enumerate(rules, 1))
    return F.expr(f"CASE {cases} ELSE 0 END")


def learn_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[list[Term]]:
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("keep"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` rows of two numbers: a broadcast is safe.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("keep").alias("keep"))
    rows = with_statistics(rows)
    got = rows.select("doc_id", "keep", "base_failed", *(F.expr(sql).alias(name) for name, sql in FEATURES.items())).collect()
    got = [r for r in got if not r["base_failed"]]
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode("utf-8")), r["doc_id"]))
    names = list(FEATURES)
    x = np.array([[r[name] for name in names] for r in got], float).reshape(-1, len(names))
    return learn(x, np.array([r["keep"] for r in got], int), names)


def apply_rules(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """doc_id, the statistics, ``base_failed``, ``rule`` (that rejected, or 0) and ``kept``."""
    df = with_statistics(docs.select("doc_id", "text")).withColumn("rule", verdict(rules))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, learn_rules(docs, table(spark, sf_dir, "labels")))
