"""Messages to MIME headers as DataFrame projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c


def recipient_lists(recipients: DataFrame, by: list[str]) -> DataFrame:
    """``to_header``, ``cc_header``, ``bcc_header`` of each message, addresses in their order; originators are left out."""
    shown = c.address("name", "email")
    cols = []
    for kind in ("to", "cc", "bcc"):
        pairs = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(F.col("ord"), shown.alias("a")))))
        cols.append(F.nullif(F.array_join(F.transform(pairs, lambda x: x["a"]), ", "), F.lit("")).alias(f"{kind}_header"))
    return recipients.groupBy(*by).agg(*cols)


def message_headers(m: dict[str, Column]) -> Column:
    """array<struct<name,value>> in the order mail has them; null values are left out.

    ``m`` maps sender_name, sender_email, to, cc, bcc, subject, date, message_id,
    in_reply_to, references, importance and sensitivity to columns.
    """
    pairs = [
        ("From", F.when(m["sender_email"].isNotNull(), c.address(m["sender_name"], m["sender_email"]))),
        ("To", m["to"]), ("Cc", m["cc"]), ("Bcc", m["bcc"]),
        ("Subject", c.encode_header(m["subject"])), ("Date", c.rfc2822(m["date"])), ("Message-ID", m["message_id"]),
        ("In-Reply-To", m["in_reply_to"]), ("References", m["references"]), ("MIME-Version", F.lit("1.0")),
        ("Importance", c.importance_header(m["importance"])), ("X-Priority", c.x_priority(m["importance"])),
        ("Sensitivity", c.sensitivity_header(m["sensitivity"])),
    ]
    made = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs))
    return F.filter(made, lambda h: h["value"].isNotNull())


def body_kind(text: Column, html: Column) -> Column:
    """Content type a message's body takes."""
    return (
        F.when(text.isNotNull() & html.isNotNull(), "multipart/alternative").when(html.isNotNull(), "text/html").otherwise("text/plain")
    )


def attachment_layout(attachments: DataFrame, by: list[str]) -> DataFrame:
    """How the parts of a message nest: counts of inline and regular files and the outer type."""
    out = attachments.groupBy(*by).agg(F.count_if("is_inline").alias("n_inline"), F.count_if(~F.col("is_inline")).alias("n_regular"))
    return out.withColumn("related", F.col("n_inline") > 0).withColumn("outer_type", F.lit("multipart/mixed"))
