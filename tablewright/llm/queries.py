"""The operators as registered queries over (session, table folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, bpe, chat, decontamination, embeddings, language_model, licenses, packing, quality, simhash, spelling, toxicity, urls,
)
from .oracles import ORACLES
from .shared import ship

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digests(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(_read(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and conversation -1, whose two turns hold the markers themselves."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], turns.schema)
    return chat.read_back(chat.format_windows(turns.union(extra)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_links(_read(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_licenses, op2_simhash, op3_bpe, op4_decontamination, op5_toxicity, op6_quality, op7_urls, op8_language_model, op9_embeddings, op10_chat, op11_spelling, op12_alignment, op13_packing)}
