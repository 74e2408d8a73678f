"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.removed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.findings(_table(spark, sf_dir, "documents"), secrets.fit())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.digests(_table(spark, sf_dir, "documents"), pieces.Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model"), k=2)


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiff
    from .blocks import prepare

    prepare(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    media = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tiff.stored_as_tiff("text").alias("media"))
    return media.withColumn("got", tiff.digested("media")).select("doc_id", "n_bytes", "got.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chosen_path

    return chosen_path.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "n_tokens")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, _table(spark, sf_dir, "labels"), columns=[])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_main

    return html_main.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_repeated_bytes, op3_language_id, op4_secret_scans, op5_sentencepiece, op6_media_tiff, op7_jaccard_join, op8_token_counts, op9_quality_classifier, op10_html_extraction)}
SQL: dict[str, str] = {}
