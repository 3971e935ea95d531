"""A corpus pipeline of five stages; each takes what the one before kept.

All stages take null ids, sources and texts, empty and very long texts, repeated rows, empty tables and extra columns of any name, which all
but the last return; what they do with them is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.llm import bpe, mixing, neardup, secrets, toxicity
from kerbline.llm.common import settled

ENCODER_SLAB = 2 << 20
"""Bytes of text that the last stage encodes together: half of the operator's, as the stages before have grown the executors' heaps."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't find toxic.

    Null and empty texts have no toxic feature and stay; each of repeated rows is judged alike; without labels nothing goes.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, once.

    Texts without words are near nothing and stay. Of rows with one id the one with the least text hash stays; rows with null ids all do.
    """
    return neardup.without_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew; null texts stay null."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to three times), in training order, which mix_time and mix_row keep.

    A null source is a source. Texts without words have no share in the mix and go; repeated rows are documents of their own.
    """
    return mixing.mix_documents(docs, order_columns=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place in training, token ids (little-endian uint32), their number and digest; null and empty texts have no ids.

    Rows that didn't go through the mix have no place.
    """
    mixed = "mix_row" in docs.columns
    placed = mixing.positions(docs.select("doc_id", "source", "text", "mix_time", "mix_row")) if mixed else docs.withColumns({"mix_time": F.lit(None).cast("double"), "position": F.lit(None).cast("long")})
    tokens = bpe.encode(placed.select("position", "mix_time", "doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, slab_text=ENCODER_SLAB)
    return tokens.select("position", "mix_time", "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None
"""The toxicity model and the encoder can't be expressed in SQL; tests compare the stages with brute-force versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back before the next; what a stage read goes once its result is written."""

    def upto(n: int) -> DataFrame:
        if n < 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        return settled(lambda: STAGES[n][1](spark, upto(n - 1), sf_dir))

    last = len(STAGES) - 1
    return STAGES[last][1](spark, upto(last - 1), sf_dir)
