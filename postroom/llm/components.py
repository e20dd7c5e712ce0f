"""Connected components of a table of links, by alternating stars.

Every round hangs the larger neighbours of a node on the smallest one, then the smaller
ones, until nothing moves; the number of rounds grows with the logarithm of the longest
path. Links stay a distributed table throughout, and each round is cut off by a
checkpoint, so a lost executor costs at most one round. Minima are combined before they
are shuffled; the joins are plain equi-joins, whose large keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MOST_ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _mark(e: DataFrame) -> tuple[int, int]:
    # A sum of hashes without their low bits can't overflow a long below 2**30 links times 2**33.
    r = e.agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 1).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) that isn't its component's smallest."""
    e = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _mark(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        e = checkpointed(_small(_large(e)))
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
