"""Input columns named like added ones in another letter case: results can be written, with one column of each name."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txgauge.llm import bpe, content_sort, knn_join, lang_id, mixing, pii, queries, simhash, suffix_index, token_counts, url_reputation

ROWS = [(1, "the same words a@b.c", "en", "web", 3), (2, "the same words a@b.c", "en", "web", 3), (2, "the same words a@b.c", "en", "web", 3), (None, None, None, None, None), (3, "", "de", None, 0)]
OPERATORS = {
    "content_sort": (content_sort.mark_copies, ("KEPT", "Keep_ID", "GROUP_SIZE", "Text_SHA256")),
    "bpe": (lambda d: bpe.encode_and_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), ("Decoded", "TOKEN_IDS")),
    "simhash": (simhash.near_duplicates, ("Fingerprint", "COMPONENT_ID", "__FP")),
    "simhash_keep": (simhash.keep_one, ("Fingerprint", "Root", "FP")),
    "mixing": (mixing.mixed, ("Taken", "SIZE", "Target", "SOURCE_SIZE")),
    "suffix_index": (suffix_index.remove_repeats, ("KEPT", "N_Bytes", "x", "ID")),
    "pii": (lambda d: pii.find(d), ("Email", "IP", "Added", "SECRET", "kind")),
    "lang_id": (lambda d: lang_id.identify(d, {"en": b" the words ", "de": b" die worte "}), ("Score", "LANG_PRED", "Rejected")),
    "token_counts": (lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")), ("N_TOKENS", "n_Bytes", "Over_Limit")),
    "knn_join": (lambda d: knn_join.top_k(d.withColumn("embedding", F.array(F.lit(1.0))), F.col("doc_id") % 2 == 0, id_col="doc_id"), ("Score", "RANK", "Vec_ID", "query_ID", "row", "cell")),
    "url_reputation": (lambda d: url_reputation.judge_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://a.b/c")), d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), queries.RULES), ("Host", "PATH", "Rule", "VERDICT", "n", "bad")),
}


def documents(spark, more):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("clash") for c in more})


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("empty", [False, True])
def test_clashing_names(spark, tmp_path, name, empty):
    f, more = OPERATORS[name]
    d = documents(spark, more)
    f(d.limit(0) if empty else d).write.parquet(f"file://{tmp_path}/t")
    got = spark.read.parquet(f"file://{tmp_path}/t")
    lower = [c.lower() for c in got.columns]
    assert len(lower) == len(set(lower))
    assert (got.count() == 0) if empty else got.count() > 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_with_clashing_names(spark, tmp_path, stage):
    name, f = corpus_pipeline.STAGES[stage]
    d = documents(spark, ("KEPT", "Score", "Taken", "Decoded", "Rejected", "__FP", "N_tokens"))
    got = f(spark, d, "")
    got.write.parquet(f"file://{tmp_path}/t")
    assert name == "encode" or got.columns == d.columns
