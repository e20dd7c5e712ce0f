"""Licence detection in whole texts, DataFrame functions alone.

Method: ordered signature rules. The text becomes lower-case words, each between spaces of
its own. A text with none of a few gate strings is done; otherwise each rule whose keyword
occurs is matched, and its places become intervals of words. Sorted by start, then length,
then priority, a detection falls away if an earlier one of no lower priority contains it.
Labels of what is left join those of the base phrases, which always stay. The score is the
highest priority left, in hundredths (0.9 for a base phrase).

All work is row by row: nothing is shuffled. Null and empty texts have no words, labels or
places and score 0; repeated rows get a row each; only the listed columns come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import GATES, rules
from .line_dedup import ascii_lower, body
from .quality_rules import held

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.9


def spaced_words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def words_in(x: str) -> str:
    return f"((length({x}) - length(replace({x}, ' ', ''))) div 2)"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def detections(norm: str) -> Column:
    """Array of (start, minus end, minus priority, label) of every place of every rule."""
    known = ", ".join(f"struct({_quoted(a)} AS label, {b} AS priority, {_quoted(k)} AS kw, {_quoted(p)} AS p)" for a, b, k, p in rules())
    # Each hit between two marks, which no word holds; a mark's place less the marks before it counts words.
    marked = f"split(trim(regexp_replace({norm}, r.p, '\\u0001$0\\u0002')), ' +', -1)"
    at = lambda mark: f"filter(transform(m, (t, i) -> CASE WHEN t = '\\u000{mark}' THEN cast(i AS bigint) END), i -> i IS NOT NULL)"
    places = f"""
      flatten(transform(array({marked}), m ->
        transform(zip_with({at(1)}, {at(2)}, (a, b) -> struct(a, b)),
                  (x, k) -> struct(x.a - 2 * k AS start, -(x.b - 2 * k - 1) AS till, -r.priority AS rank, r.label AS label))))"""
    gate = " OR ".join(f"contains({norm}, {_quoted(g)})" for g in GATES)
    return F.expr(f"CASE WHEN {gate} THEN flatten(transform(filter(array({known}), r -> contains({norm}, r.kw)), r -> {places})) END")


def survivors(found: str) -> Column:
    """Array of (label, priority) of detections that none of no lower priority contains."""
    # ``reach`` has, for each priority from 30 to 90, how far detections of that or a higher one go.
    return F.expr(f"""
      aggregate(sort_array({found}),
        struct(array_repeat(-1L, 7) AS reach, cast(array() AS array<struct<label: string, priority: int>>) AS kept),
        (a, d) -> struct(
          transform(a.reach, (e, k) -> CASE WHEN 30 + 10 * k <= -d.rank THEN greatest(e, -d.till) ELSE e END) AS reach,
          CASE WHEN element_at(a.reach, cast((-d.rank - 20) div 10 AS int)) >= -d.till THEN a.kept
               ELSE array_union(a.kept, array(struct(d.label AS label, -d.rank AS priority))) END AS kept),
        a -> a.kept)""")


def scan_licenses(docs: DataFrame) -> DataFrame:
    df = docs.select("doc_id", held(spaced_words(body())).alias("norm"))
    pieces = {f"p{k}": held(F.when(F.contains("norm", F.lit(f" {x.replace(' ', '  ')} ")), F.split("norm", f" {x.replace(' ', '  ')} ", -1))) for k, x in enumerate(PHRASES)}
    df = df.withColumns({**pieces, "found": held(detections("norm"))})
    df = df.withColumn("kept", held(F.coalesce(survivors("found"), F.expr("cast(array() AS array<struct<label: string, priority: int>>)"))))
    n_base = sum((F.coalesce(F.size(p) - 1, F.lit(0)) for p in pieces), F.lit(0))
    firsts = [F.expr(words_in(f"element_at({p}, 1)")) for p in pieces]
    lasts = [F.expr(f"{words_in('norm')} - {words_in(f'element_at({p}, -1)')} - {len(x.split())}") for p, x in zip(pieces, PHRASES, strict=True)]
    base = F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), F.lit(label)) for p, label in zip(pieces, PHRASES.values(), strict=True))))
    own = F.transform("kept", lambda x: x["label"])
    return df.select(
        "doc_id",
        F.expr(words_in("norm")).cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(
            F.when(n_base > 0, F.lit(BASE_SCORE)).otherwise(0.0),
            F.coalesce(F.array_max(F.transform("kept", lambda x: x["priority"])), F.lit(0)) / 100.0,
        ).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
