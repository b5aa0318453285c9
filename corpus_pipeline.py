"""The corpus pipeline: classifier, rules, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads
again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cotrain import accepted
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import in_mixture_order
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import passing
from tidemark.llm.workspace import Workspace

TOKENIZER, END_ID, SEQUENCE = "word_bpe_49k.json", 1, 4096
SHINGLE_WORDS, SIMILARITY, ROW = 5, Fraction(4, 5), "row_key"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, labels)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the current policy."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: the row with the smallest doc_id, one row even if ids repeat or are null."""
    ws = Workspace(spark, "dedup")
    keyed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias(ROW))
    rows = ws.save(keyed)  # written, so that a row keeps its key
    scratch = Workspace(spark, "judged")
    with scratch.around():
        judged = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "row.text"), SHINGLE_WORDS, SIMILARITY)
    judged = ws.save(judged.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "row.doc_id"), ROW))
    scratch.close()  # nothing reads its tables any more, and the next stages need the room
    first = judged.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW].alias(ROW))
    dropped = ws.save(judged.select(ROW).join(first, ROW, "left_anti"))
    return rows.join(dropped, ROW, "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed."""
    return in_mixture_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER), END_ID, SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` and returns the packed pieces.

    What a stage leaves for itself in the shared folder is deleted when its result is written, and that when the next one's is.
    """
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        scratch = Workspace(spark, name)
        with scratch.around():
            docs = ws.save(stage(spark, docs, sf_dir))
        scratch.close()
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
