"""The corpus pipeline: quality, near copies, secrets, packing; each stage works on all that the one before kept.

All stages but the last return the columns of documents, extra ones too, whatever their names. An empty table goes through as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import co_training, histogram_packing, near_copies, secret_scan
from terrace.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores 0.5 or more.

    Null and empty texts are scored like any other; rows of null or repeated ids are each kept or rejected by their own text; too few
    labels reject nothing."""
    return co_training.rejected(docs, co_training.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Null and empty texts are one group; a null id comes after all others; repeated rows are copies; texts may be of any length."""
    return near_copies.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[secret]`` in place of each secret, and n_chars of the new text.

    Rows without secrets, null texts among them, stay as they are; overlapping spans are one mark; rows of null or repeated ids are
    told apart by their texts."""
    found = secret_scan.scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("i"), "digest", "spans").dropDuplicates(["i", "digest"])
    found = written(found, "secret-spans")
    joined = docs.alias("d").join(found.alias("s"), F.expr("d.doc_id <=> s.i and xxhash64(coalesce(d.text, '')) = s.digest"), "left")
    text = F.when(F.col("s.spans").isNotNull(), secret_scan.redact(F.col("d.text"), F.col("s.spans"))).otherwise(F.col("d.text"))
    n_chars = F.when(F.col("s.spans").isNotNull(), F.length(text)).otherwise(F.col("d.n_chars"))
    new = {"text": text, "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return joined.select(*(new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens.

    A null or empty text is its end alone; repeated rows are packed again; ties go by id."""
    return histogram_packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: Training and tokenising can't be written in SQL; each stage is tested against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
