"""The pipeline, stage by stage on each stage's own input, against brute force."""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import tiktoken
from test_jaccard import slow_kept
from test_rows import slow_targets

import corpus_pipeline
from txgauge.llm import lang_id, mixing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents and each stage's result, each written and read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        out.append(docs)
        path = f"file://{tmp_path_factory.mktemp(name)}/t"
        f(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert {"doc_id", "n_tokens", "token_ids", "text"} <= set(steps[-1].columns)


def test_language(steps):
    docs, kept = steps[0], steps[1]
    classifier = lang_id.Classifier(lang_id.learn(docs))
    want = [r.doc_id for r in docs.collect() if (x := classifier.classify(r.text))[0] != "und" and x[1] >= 0.02]
    assert ids(kept) == sorted(want) and len(want) > 0.95 * docs.count()


def test_exact(steps):
    first = {}
    for r in steps[1].orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(steps[2]) == sorted(first.values())


def test_near(steps):
    assert ids(steps[3]) == slow_kept({r.doc_id: r.text for r in steps[2].collect()})[0]


def test_mix(steps):
    docs = steps[3].collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source, sizes = {r.doc_id: r.source for r in docs}, defaultdict(int)
    for d, s in source.items():
        sizes[s] += words[d]
    want, got, taken = slow_targets(sizes, (5, 2, 1), 1.0, 3), Counter(ids(steps[4])), defaultdict(int)
    for d, n in got.items():
        taken[source[d]] += n * words[d]
    assert max(got.values()) <= 3 and set(got) <= set(words)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(words[d] for d in words if source[d] == s)
    again = mixing.mixed(steps[3]).collect()
    assert {r.doc_id: r.taken for r in again if r.taken} == {d: n * words[d] for d, n in got.items()}


def test_encode(steps):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("pipeline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    assert ids(steps[4]) == ids(steps[5])
    for r in steps[5].collect():
        want = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and bytes(r.token_ids) == b"".join(x.to_bytes(4, "little") for x in want) and r.text == texts[r.doc_id]


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(steps[5])


def test_run_computes_each_stage_once(spark, monkeypatch):
    """However often a stage reads its input, what comes before is not computed again."""
    passed = spark.sparkContext.accumulator(0)
    first = corpus_pipeline.STAGES[0][1]

    def counted(spark, docs, sf_dir):
        def look(batches):
            for b in batches:
                passed.add(b.num_rows)
                yield b

        out = first(spark, docs, sf_dir)
        return out.mapInArrow(look, out.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("language", counted), *corpus_pipeline.STAGES[1:]])
    corpus_pipeline.run(spark, SMALL).count()
    kept = first(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).count()
    assert passed.value == kept


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "web", 3), (2, "", None, None, 0), (3, "the same words", "en", "web", 1), (3, "the same words", "en", "web", 1), (4, "x " * 50_000, "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            got = f(spark, d, SMALL).collect()
            assert d is docs or not got
            assert name == "encode" or all(set(r.asDict()) == set(docs.columns) for r in got)
