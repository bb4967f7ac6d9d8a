"""Exact dedup, SimHash near-dedup and removal of repeated passages, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from pyspark.sql import functions as F

from txgauge.llm import components, content_sort, simhash, suffix_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def edge_texts():
    return [(3, None), (1, ""), (2, ""), (4, " \t\n"), (5, "a b"), (6, "a  b"), (7, "a\x0bb"), (8, "a\xa0b"), (9, "A b"), (5, "a b"), (None, "a b"), (None, None), (10, "é" * 5000), (11, "é" * 5000)]


@pytest.mark.parametrize("how", [{"least_hot": 2}, {"least_hot": 64}, {"least_bytes": 100}])
def test_content_sort(spark, how):
    texts = edge_texts() + [(100 + i, "hot text") for i in range(40)] + [(200 + i, f"text {i % 7}") for i in range(30)]
    got = content_sort.mark_copies(frame(spark, texts), **how).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    assert len(got) == len(texts)
    for r in got:
        norm = SPACE.sub(" ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r.keep_id == (min(ids) if ids else None)
        assert r.group_size == len(groups[norm])
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    for norm in groups:
        kept = [r for r in got if SPACE.sub(" ", r.text or "") == norm and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    left = content_sort.drop_copies(frame(spark, texts), **how).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(r.doc_id) for r in got if r.kept)


def test_content_sort_empty_and_clashing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert content_sort.mark_copies(empty).collect() == []
    d = spark.createDataFrame([(1, "x", 9, "k"), (2, "x", 9, "k")], "doc_id long, text string, group_size int, kept string")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in content_sort.mark_copies(d).collect()) == [(1, 2, True), (2, 2, False)]
    assert content_sort.drop_copies(d).count() == 1


def slow_fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_texts(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 6])):
            t = list(base)
            if len(t) > 10:
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            texts.append((" " if rnd.random() < 0.3 else "\t").join(t))
    return list(enumerate([*texts, None, "", " \n", "Wörter Ähnlich ÄÖ", "WÖRTER"], 1))


def test_fingerprint():
    for _, t in near_texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    assert simhash.fingerprint("a b c " * 300_000) == slow_fingerprint("a b c " * 300_000)


@pytest.mark.parametrize("distance", [2, 6])
def test_near_duplicates(spark, distance):
    texts = near_texts()
    fps = {i: slow_fingerprint(t) for i, t in texts}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= distance]
    want = slow_components(fps, links)
    got = simhash.near_duplicates(frame(spark, texts), distance).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in fps.items()}
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, texts), distance).collect()}
    assert kept == set(want.values())


def test_linked_in_large_buckets(spark):
    """Random and crowded fingerprints; buckets are split again whenever they hold more than four."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)] + [rnd.getrandbits(6) for _ in range(40)]
    fps = sorted({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) if rnd.random() < 0.8 else b for b in base for _ in range(6)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, small=4)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    index = {x: i for i, x in enumerate(signed)}
    links = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and (a ^ b).bit_count() <= 2]
    want = slow_components(range(len(fps)), links)
    got = slow_components(range(len(fps)), [(index[a], index[b]) for a, b in roots.items()])
    assert got == want


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = simhash.near_duplicates(frame(spark, edge_texts()))
    assert got.count() == len(edge_texts())
    zero = [r.component_id for r in got.filter("fingerprint = '0000000000000000'").collect()]
    assert zero == [1] * 5
    twice = frame(spark, [(1, "some words here and there"), (1, "some words here and there")])
    assert [r.component_id for r in simhash.near_duplicates(twice).collect()] == [1, 1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("one_task", [-1, 60, components.ONE_TASK])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, one_task):
    """All rounds, rounds until few edges are left, one task from the start; after each round shuffles are let go."""
    rnd, released = random.Random(2), []
    monkeypatch.setattr(components, "release", lambda spark: released.append(spark))
    ids = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(150)]
    links = [tuple(rnd.sample(ids, 2)) for _ in range(70)] + list(zip(ids[:40], ids[1:41], strict=True))
    got = components.components(spark.createDataFrame([*links, (ids[0], ids[0])], "a long, b long"), one_task=one_task).collect()
    linked = {i for e in links for i in e}
    assert {r.node: r.root for r in got} == slow_components(linked, links) and len(got) == len(linked)
    assert bool(released) == (one_task < len(links))


def test_components_of_a_small_graph_take_few_tasks(spark):
    """However many partitions there are, a long chain is not shuffled through all of them round by round."""
    context, parts = spark.sparkContext, 40
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("small graph", "")
        got = components.components(spark.range(500).selectExpr("id as a", "id + 1 as b")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.root for r in got} == {0} and len(got) == 501
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("small graph") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(seen.getStageInfo(s).numCompletedTasks for s in stages if seen.getStageInfo(s))
    assert tasks <= 5 * parts


def slow_removed(texts, length=200):
    seen = {}
    raws = [(t or "").encode() for _, t in texts]
    for k, raw in enumerate(raws):
        for at in range(len(raw) - length + 1):
            seen.setdefault(raw[at : at + length], []).append((k, at))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, at in places:
                gone[k][at : at + length] = b"\1" * length
    return raws, gone


def repeat_texts():
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    shared = [prose(60) for _ in range(5)]
    texts = []
    for i in range(40):
        parts = [prose(rnd.randrange(0, 80))]
        for s in rnd.sample(shared, rnd.randrange(0, 3)):
            cut = rnd.randrange(0, 60)
            parts += [s[cut : cut + rnd.choice([150, 199, 200, 201, 260, 400])], prose(rnd.randrange(0, 40))]
        texts.append((i, " ".join(parts)))
    own = prose(50)
    texts += [(50, own + " - " + own), (51, "x" * 900), (52, "ab" * 300), (53, "é" * 250), (54, "x" * 450), (55, None), (56, ""), (57, "short"), (58, texts[0][1]), (58, texts[0][1]), (None, shared[0]), (None, prose(90))]
    return texts


@pytest.mark.parametrize("how", [{}, {"batches": 2}, {"batches": 5}, {"batches": 9}, {"most_kinds": 1}])
def test_remove_repeats(spark, how):
    texts = repeat_texts()
    raws, gone = slow_removed(texts)
    want = []
    for (i, _), raw, g in zip(texts, raws, gone, strict=True):
        spans = sum(1 for a, b in zip(b"\0" + bytes(g), bytes(g), strict=False) if b and not a)
        want.append((i, len(raw), sum(g), spans, bytes(x for x, y in zip(raw, g, strict=True) if not y)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_index.remove_repeats(frame(spark, texts), **how).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("batches", "sizes"), [(2, {1: 2}), (5, {0: 1, 2: 4}), (7, {0: 1, 1: 2, 2: 4}), (9, {0: 1, 3: 8})])
def test_levels_merge_geometrically(spark, batches, sizes):
    """Level i holds 2**i batches, ordered within its buckets, with all their entries."""
    docs = frame(spark, repeat_texts()).selectExpr("doc_id AS id", "xxhash64(text) AS x", "coalesce(text, '') AS text")
    found = suffix_index.anchor_entries(docs).withColumn("batch", F.abs(F.col("x")) % batches).cache()
    index = suffix_index.SuffixIndex(4)
    for b in range(batches):
        index.add(found.filter(F.col("batch") == b))
    assert set(index.levels) == set(sizes)
    assert sum(r.n for level in index.levels.values() for r in level.collect()) == found.count()
    first = sizes[max(sizes)]
    want = {(r.k, r.h, r.t): r.n for r in found.filter(F.col("batch") < first).groupBy("k", "h", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.k, r.h, r.t): r.n for r in index.levels[max(sizes)].collect()} == want
    top = index.levels[max(sizes)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = top.join(top.select("k", "h"), ["k", "h"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    found.unpersist()


def test_windows_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    """With a hash that is always the same, only equal windows count."""
    import numpy as np
    import pandas as pd

    rnd = random.Random(6)
    text = bytes(rnd.randrange(97, 105) for _ in range(420))
    other = bytes(rnd.randrange(97, 105) for _ in range(420))
    blocks = [text[:300], text[40:300], other[:260], text[100:300] + other[:30]]
    d = pd.DataFrame({"id": [1, 2, 3, 4], "x": 0, "h": 5, "t": [1, 2, 3, 4], "n": 1, "a": [140, 100, 120, 60], "o": [140, 100, 120, 40], "block": blocks})
    want = suffix_index.shared_windows(d)
    monkeypatch.setattr(suffix_index, "_hashes", lambda m: np.zeros((len(m), suffix_index.LEFT + 1), np.uint64))
    got = suffix_index.shared_windows(d)
    assert len(want) and got.values.tolist() == want.values.tolist()


def test_remove_repeats_edges(spark):
    assert suffix_index.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    d = spark.createDataFrame([(1, "no repeats here", "k")], "doc_id long, text string, kept string")
    r = suffix_index.remove_repeats(d).collect()[0]
    assert (r.n_removed, bytes(r.kept)) == (0, b"no repeats here")
