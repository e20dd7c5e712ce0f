"""Trees kept as parent links: walks, children and chains, of any size and depth.

Walks and chains double the stretch they know in every round, so a path of n links takes
log2(n) rounds of one equi-join each; rounds are cut off by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rounds after which a path would be longer than any table; only loops get there.
MOST_ROUNDS = 60


def _label() -> Column:
    return F.concat(F.lpad(F.col("ord").cast("string"), 10, "0"), F.lit(":"), F.col("id").cast("string"))


def walk(nodes: DataFrame, root: int) -> DataFrame:
    """``file_id, id, parent_id, depth, path`` of what ``root`` reaches, each file apart.

    ``nodes`` has file_id, id, parent_id and ord (the order among siblings). Sorting by
    path gives pre-order. A node met again on its own path ends that path, so loops end.
    """
    nodes = nodes.select("file_id", "id", "parent_id", "ord")
    roots = nodes.filter(F.col("id") == root).select("file_id", "id", "parent_id", F.lit(0).alias("depth"), _label().alias("path"))
    below = nodes.filter((F.col("id") != root) & (F.col("id") != F.col("parent_id")))
    # Each row knows the way from an ancestor, not included, down to its node.
    known = checkpointed(below.select("file_id", "id", "parent_id", F.col("parent_id").alias("top"), F.lit(1).alias("depth"), F.concat(F.lit("/"), _label()).alias("way")))
    for _ in range(MOST_ROUNDS):
        is_open = F.col("top") != root
        if known.filter(is_open).isEmpty():
            break
        upper = known.select("file_id", F.col("id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("way").alias("upper"))
        longer = known.filter(is_open).join(upper, ["file_id", "top"])
        longer = longer.select("file_id", "id", "parent_id", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("upper", "way").alias("way"))
        loops = F.contains(F.concat("way", F.lit("/")), F.concat(F.lit(":"), F.col("top").cast("string"), F.lit("/")))
        known = checkpointed(known.filter(~is_open).unionByName(longer.filter(~loops)))
    tops = roots.select("file_id", F.col("path").alias("start"))
    reached = known.filter(F.col("top") == root).join(tops, "file_id").select("file_id", "id", "parent_id", "depth", F.concat("start", "way").alias("path"))
    return roots.unionByName(reached)


def children(nodes: DataFrame) -> DataFrame:
    """Ordered children of each node that is there; parent 0 or unknown attaches nowhere."""
    own = nodes.select("file_id", F.col("id").alias("parent_id"))
    kids = nodes.filter("parent_id <> 0").join(own, ["file_id", "parent_id"], "left_semi")
    pairs = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return kids.groupBy("file_id", "parent_id").agg(F.transform(pairs, lambda x: x["id"]).alias("children"))


def chain(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, id, hop`` along ``links`` (id, next) from each of ``starts`` (start), to a link that isn't there.

    A chain ends before a link that it has passed.
    """
    jump = checkpointed(links.select("id", "next").filter("next IS NOT NULL"))
    found = checkpointed(starts.select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("hop")))
    size, step = found.count(), 1
    for _ in range(MOST_ROUNDS):
        # What lies ``step`` further on from all that is known; a link met twice counts where it came first.
        further = found.join(jump, "id").select("start", F.col("next").alias("id"), (F.col("hop") + step).alias("hop"))
        found = checkpointed(found.unionByName(further).groupBy("start", "id").agg(F.min("hop").alias("hop")))
        now = found.count()
        if now == size:
            break
        far = jump.select(F.col("id").alias("next"), F.col("next").alias("far"))
        size, step = now, 2 * step
        jump = checkpointed(jump.join(far, "next").select("id", F.col("far").alias("next")).distinct())
    return found.withColumn("hop", F.col("hop").cast("int"))
