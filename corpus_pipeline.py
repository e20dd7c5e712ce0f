"""A corpus pipeline of five stages, each an operator of ``postroom.llm``.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents`` with ``text`` and ``n_chars`` as the stage leaves them:

1. toxicity: documents that score as toxic go;
2. line dedup: lines that a document with a smaller doc_id holds go;
3. near dedup: of documents with near fingerprints the smallest doc_id stays;
4. decontamination: documents that hold a benchmark item within the edit budget go;
5. packing: what is left is tokenised and packed into sequences (one row a piece).

Null texts and repeated rows are as each operator defines them; an empty table passes
through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.common import Scratch, table
from postroom.llm.decontamination import decontaminate
from postroom.llm.line_dedup import dedup_lines
from postroom.llm.packing import pack_documents
from postroom.llm.simhash import keep_one
from postroom.llm.toxicity import fit, reject_toxic

#: Learn from rows outside this remainder of crc32(doc_id), as the toxicity query does.
FOLDS, HELD = 3, 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, fit(docs, table(spark, sf_dir, "labels"), FOLDS, HELD))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the learned scores nor the fingerprints; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    try:
        for number, (_, stage) in enumerate(STAGES[:-1], 1):
            docs = scratch.keep(stage(spark, docs, sf_dir))
            if number > 1:
                scratch.drop(number - 1)
        return STAGES[-1][1](spark, docs, sf_dir)  # written by the operator itself
    finally:
        scratch.close()
