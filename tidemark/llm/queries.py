"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import spelling, sql
from .cotrain import quality_scores
from .embed_dedup import near_vectors
from .language import identify
from .minhash import near_duplicates
from .mixing import mixture_plan
from .packing import pack
from .quality_rules import quality_digest, quality_ledger
from .repeats import periodic_tail, run_digest
from .separator_scan import count_tokens
from .token_files import token_file_digest
from .url_filter import Rule, filter_urls
from .warc import warc_round_trip
from .workspace import Workspace

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEPARATOR_ID = 49407  # <|endoftext|>
URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Workspace(spark, "quality").save(quality_ledger(_table(spark, sf_dir, "documents")))
    return quality_digest(ledger)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, similarity=Fraction(85, 100))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), similarity=0.9)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), SEPARATOR_ID)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_plan(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents as the contract spoils them: a run whose checksum 31 divides loses a code point; a null doc_id counts as an empty one there."""
    runs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.letter_runs()).alias("run"))
    runs = runs.where(F.length("run") >= spelling.SHORTEST)  # shorter ones stay too short
    checksum = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = spelling.word_counts(runs.withColumn("h", checksum).select(spoilt.alias("word")))
    return spelling.group_variants(words)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(_table(spark, sf_dir, "documents"), change=periodic_tail)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash": op4_minhash,
    "op5_embeddings": op5_embeddings,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": sql.URLS,
    "op3_quality_rules": sql.QUALITY,
    "op4_minhash": sql.MINHASH,
    "op5_embeddings": sql.EMBEDDINGS,
    "op7_warc": sql.WARC,
    "op11_spelling_variants": sql.SPELLING,
}
