"""A corpus pipeline: language ID, exact dedup, near-dedup, source mixing, BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.llm import bpe, content_sort, lang_id, mixing, simhash
from txgauge.llm.common import release, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    found = lang_id.identify(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}), lang_id.learn(docs), text_col="__in_text")
    return found.filter(~F.col("rejected")).select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return content_sort.drop_copies(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word Jaccard similarity of 0.8 or more."""
    return simhash.keep_similar(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixing.emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them."""
    out = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    n = (F.octet_length("token_ids") / 4).cast("long")
    return out.select("doc_id", "lang", "source", n.alias("n_tokens"), "token_ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written before the next reads it and deleted after that."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if old is not None:
            release(spark, old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
