"""A corpus made ready for training: each stage reads what the one before has written.

Defined cases, for all stages: an empty table gives an empty one. A null text counts as empty and stays
null. Rows with equal or null ids are rows of their own, but for the SimHash stage, as it says. Other
columns, whatever their names, are carried along by all stages but the last. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import bpe, decontamination, quality, simhash, toxicity
from tablewright.llm import queries as registered
from tablewright.llm.shared import ship, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject: all of them where labels name one class only, or none.

    An empty or null text scores what the model gives without words. Equal texts score alike.
    """
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject: all of them where labels name one class only, or none.

    An empty or null text scores the share of good labels. Equal texts score alike.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Empty and null texts are one group. Of rows with that id one stays for each group, the one that comes first
    by fingerprint, text and other columns. Rows without an id all stay.
    """
    ship(spark)
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark passages of contaminated ones; those that are nothing else go.

    Null and empty texts are clean. Items without an id, a text or words don't count.
    """
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document; an empty or null text has no ids."""
    ship(spark)
    return bpe.token_digests(docs, registered.tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", keep_one_of_group),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

#: Trained models, XXH64 fingerprints and merges can't be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs


QUERIES = registered.QUERIES | {"pipeline": run}
ORACLES = dict(registered.ORACLES)
