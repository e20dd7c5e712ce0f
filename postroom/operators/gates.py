"""Metrics and policy gates over decoded mail: snapshots, comparisons, tolerances, allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import get_header, normal_text, preview, within

BODY, HTML, EML_BODY = (128, 0.02), (4096, 0.05), (64, 0.20)
MOST_WARNINGS, MOST_CODES = 50, 20
SEVERITY = {"high": ("subject", "recipient_count", "attachment_count", "parse_error"), "medium": ("body_len", "first_recipient_email", "html_len")}


def snapshot(messages: DataFrame, recipients: DataFrame, attachments: DataFrame, by: list[str]) -> DataFrame:
    """Metric row of each message: counts, first address, lengths and hashes of the bodies."""
    r = recipients.groupBy(*by).agg(F.count("*").alias("recipient_count"), F.min_by("email", "ord").alias("first_recipient_email"))
    a = attachments.groupBy(*by).agg(F.count("*").alias("attachment_count"))
    body, html = F.coalesce("body", F.lit("")), F.coalesce("body_html", F.lit(""))
    out = messages.join(r, by, "left").join(a, by, "left")
    return out.select(
        *by, normal_text("subject").alias("subject"), F.coalesce("recipient_count", F.lit(0)).alias("recipient_count"), F.coalesce("attachment_count", F.lit(0)).alias("attachment_count"),
        "first_recipient_email", F.octet_length(body).alias("body_len"), F.octet_length(html).alias("html_len"),
        F.sha2(body.cast("binary"), 256).alias("body_sha256"), F.sha2(html.cast("binary"), 256).alias("html_sha256"), preview(body).alias("body_preview"),
    )


def severity(field: Column) -> Column:
    out = F.lit(None).cast("string")
    for level, names in SEVERITY.items():
        out = F.when(field.isin(*names), level).otherwise(out)
    return F.coalesce(out, F.lit("low"))


def unpivoted(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, field, value as text)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.field", "p.value")


def compare_parsers(rows: DataFrame, fields: list[str], by: str = "file_id") -> DataFrame:
    """Fields on which the rows of one file, one for each parser, disagree; null counts as a value."""
    long = unpivoted(rows, [by, "parser"], fields)
    value = F.coalesce("value", F.lit("\0"))
    out = long.groupBy(by, "field").agg(F.count_distinct(value).alias("n_values"))
    return out.filter("n_values > 1").withColumn("severity", severity(F.col("field")))


def baseline_diff(baseline: DataFrame, other: DataFrame, by: str, exact: list[str], lengths: dict[str, tuple[int, float]]) -> DataFrame:
    """Issues (by, field, severity): rows on one side only, exact fields that differ, lengths out of tolerance."""
    b = baseline.select(F.col(by), F.lit(True).alias("__b"), *(F.col(c).alias(f"b_{c}") for c in (*exact, *lengths)))
    o = other.select(F.col(by), F.lit(True).alias("__o"), *(F.col(c).alias(f"o_{c}") for c in (*exact, *lengths)))
    both = b.join(o, by, "full_outer")
    there = F.col("__b").isNotNull() & F.col("__o").isNotNull()
    issues = [F.when(F.col("__o").isNull(), F.lit("missing_row")), F.when(F.col("__b").isNull(), F.lit("extra_row"))]
    issues += [F.when(there & ~F.col(f"b_{c}").eqNullSafe(F.col(f"o_{c}")), F.lit(c)) for c in exact]
    issues += [F.when(there & ~F.coalesce(within(f"b_{c}", f"o_{c}", *t), F.lit(False)), F.lit(c)) for c, t in lengths.items()]
    out = both.select(by, F.explode(F.array_compact(F.array(*issues))).alias("field"))
    return out.withColumn("severity", F.when(F.col("field").isin("missing_row", "extra_row"), "high").otherwise(severity(F.col("field"))))


def violations(issues: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Issues that no rule allows; a null in a rule stands for any value.

    Rules are a policy file, a handful of rows; the count decides, and only a small table
    is sent whole. Each issue is tested against the rules without being multiplied.
    """
    hit = None
    for k in keys:
        one = F.col(f"r.{k}").isNull() | (F.col(f"r.{k}") == F.col(f"i.{k}"))
        hit = one if hit is None else hit & one
    small = F.broadcast(rules) if rules.limit(10_001).count() <= 10_000 else rules
    return issues.alias("i").join(small.alias("r"), hit, "left_anti")


def semantic_failures(baseline: DataFrame, other: DataFrame, by: str, must_match: list[str]) -> DataFrame:
    """Mismatches that fail: fields that must agree, lengths that drift, HTML that vanished."""
    both = baseline.alias("b").join(other.alias("o"), by)
    fails = [F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in must_match]
    fails += [
        F.when(~within("b.body_len", "o.body_len", *BODY), F.lit("body_len")),
        F.when(~within("b.html_len", "o.html_len", *HTML), F.lit("html_len")),
        F.when((F.col("b.html_len") > 0) & (F.col("o.html_len") == 0), F.lit("html_lost")),
    ]
    return both.select(by, F.explode(F.array_compact(F.array(*fails))).alias("failure"))


def eml_failures(ours: DataFrame, theirs: DataFrame, by: str, must_match: list[str]) -> DataFrame:
    both = ours.alias("b").join(theirs.alias("o"), by)
    fails = [F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in must_match]
    fails.append(F.when(~within("o.body_len", "b.body_len", *EML_BODY), F.lit("body_len")))
    return both.select(by, F.explode(F.array_compact(F.array(*fails))).alias("failure"))


def normal_addresses(value: Column) -> Column:
    """Addresses of a header in lower case, sorted, joined by commas."""
    found = F.regexp_extract_all(F.lower(value), F.lit(r"[\w.+-]+@[\w.-]+"), F.lit(0))
    return F.array_join(F.array_sort(found), ",")


def eml_rows(parts: DataFrame, by: str = "file_id") -> DataFrame:
    """``by, subject, sender, receivers, body_len``: what parsers of mail are compared by, from the rows of whole messages."""
    top = parts.filter(F.size("part_path") == 0)
    address = lambda name: normal_addresses(get_header("headers", name))
    return top.select(
        by, get_header("headers", "Subject").alias("subject"), address("From").alias("sender"), address("To").alias("receivers"),
        F.octet_length("body").cast("long").alias("body_len"),
    )


def warning_gate(warnings: DataFrame, allowed: list[str], fail_severities: list[str], most: int = MOST_WARNINGS, by: str = "file_id") -> DataFrame:
    """(by, reason, n): the first failing rule of each warning, and files with too many."""
    reason = (
        F.when(~F.col("code").isin(*allowed), "unknown_code")
        .when(F.col("severity").isin(*fail_severities), "severity")
        .when(~F.col("recoverable"), "unrecoverable")
    )
    each = warnings.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy(by, "reason").agg(F.count("*").alias("n"))
    many = warnings.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return each.unionByName(many.select(by, F.lit("too_many").alias("reason"), "n"))


def store_gate(warnings: DataFrame, expected: DataFrame, by: str = "file_id", most: int = MOST_CODES) -> DataFrame:
    """Codes of each store against those expected of it: ``missing`` where none of them came, ``too_many`` beyond ``most``."""
    codes = warnings.groupBy(by).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = expected.join(codes, by, "full_outer").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    missing = F.col("expected").isNotNull() & (F.size("expected") > 0) & ~F.arrays_overlap("codes", "expected")
    fails = F.array_compact(F.array(F.when(missing, F.lit("missing")), F.when(F.size("codes") > most, F.lit("too_many"))))
    return out.select(by, "codes", fails.alias("failures"))


def store_probe(items: DataFrame, by: str = "file_id") -> DataFrame:
    kind = F.col("type")
    return items.groupBy(by).agg(
        F.count("*").alias("items"), F.count_if(kind.isin("folder", "root")).alias("folders"), F.count_if(kind == "message").alias("messages")
    )


def field_diff(a: DataFrame, b: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, field, left, right) of fields that differ, null-safe."""
    x, y = unpivoted(a, [by], fields), unpivoted(b, [by], fields).withColumnRenamed("value", "right")
    return x.withColumnRenamed("value", "left").join(y, [by, "field"]).filter(~F.col("left").eqNullSafe(F.col("right")))
