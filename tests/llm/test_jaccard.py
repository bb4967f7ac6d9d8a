"""Near-dedup by Jaccard similarity, and the pipeline's near stage, against brute force."""

from __future__ import annotations

import random
from functools import partial
from itertools import combinations

import numpy as np
import pytest
from test_dedup import frame, slow_components

import corpus_pipeline
from txgauge.llm import jaccard


def slow_kept(texts):
    """Ids of the smallest document of each component, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    links = [(a, b) for a, b in combinations(sets, 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    return sorted(set(slow_components(sets, links).values())), links


def copies(seed=3):
    """Texts with copies around the least similarity, chains, shared halves, and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    common, out = [word() for _ in range(60)], []
    for k in range(30):
        base = [word() for _ in range(rng.choice((20, 60, 150)))]
        if k % 3 == 0:
            base = common + base[:40]
        for _ in range(rng.randrange(1, 5)):
            out.append(" ".join(base))
            base = [w if rng.random() > 0.012 else word() for w in base]
    big = [word() for _ in range(100)]
    out += [" ".join([*big[:i], "x" + str(i), *big[i + 1 :]]) for i in range(0, 100, 4)]
    out += ["", "  ", None, "one", "One", "a b c d", "a b c d e", "a b c d e f", "one two"]
    rng.shuffle(out)
    return dict(enumerate(out))


def got_kept(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stage_is_jaccard(spark):
    """Near copies whose fingerprints differ in more than two bits."""
    texts = copies()
    want, links = slow_kept(texts)
    assert len(links) > 100
    assert got_kept(corpus_pipeline.near(spark, frame(spark, texts.items()), "")) == want


@pytest.mark.parametrize("least_hot", [2, 8])
def test_hot_shingles(spark, least_hot):
    texts = copies(4)
    assert got_kept(jaccard.keep_one(frame(spark, texts.items()), least_hot=least_hot)) == slow_kept(texts)[0]


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, links = slow_kept({r.doc_id: r.text for r in docs.collect()})
    assert links and got_kept(jaccard.keep_one(docs)) == want


def test_forest_in_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "_ROWS", 3)
    monkeypatch.setattr(jaccard, "_COLS", 7)
    texts = {i: t for i, t in copies(5).items() if t and len(t.split()) > 5}
    sets = [jaccard.shingles(t) for t in texts.values()]
    found = jaccard.forest(np.array(list(texts)), sets)
    assert sorted(set(slow_components(texts, found).values())) == slow_kept(texts)[0]


def test_sketches_keep_similar_pairs():
    """Of many pairs at the least similarity none is left out, most unlike ones are."""
    rng = np.random.default_rng(4)
    for n in (1, 5, 9, 45, 200, 900, 5000):
        for _ in range(40):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            one, two, far = (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (n // 8, n // 4 - n // 8, n))
            a, b, c = (np.unique(np.concatenate([common, x])) for x in (one, two, far))
            pair = lambda x, y: jaccard.candidates(np.array([1, 2]), np.array([len(x), len(y)]), [jaccard.sketch(x), jaccard.sketch(y)])
            assert pair(a, b) == [(1, 2)]
            assert n < 45 or pair(a, c) == []


def slow_sim(text):
    """SimHash fingerprint of the set of words."""
    h = [int(jaccard.shingles(w)[0]) for w in set((text or "").encode().lower().decode().split())] or [int(jaccard.shingles("")[0])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(texts, distance):
    """Class by document: the smallest one that links of close fingerprints lead to."""
    sims = {i: slow_sim(t) for i, t in texts.items()}
    return slow_components(sims, [(a, b) for a, b in combinations(sims, 2) if (sims[a] ^ sims[b]).bit_count() <= distance])


def no_buckets(texts, rows, words, least_hot):
    return rows.select(rows["__fp"].alias("bucket"), "__fp").limit(0)


def test_stage_probes_fingerprints(spark, monkeypatch):
    """A near copy with a close fingerprint is found without prefixes, a similar text with a farther one is not."""
    monkeypatch.setattr(jaccard, "_buckets", no_buckets)
    base = [f"w{i}" for i in range(300)]
    changed = lambda n: " ".join(["x" + w if i % 20 == 7 and i < 20 * n else w for i, w in enumerate(base)])
    texts = {1: " ".join(base), 2: changed(1), 3: changed(6)}
    assert (slow_sim(texts[1]) ^ slow_sim(texts[2])).bit_count() <= 3 < min((slow_sim(texts[3]) ^ slow_sim(texts[k])).bit_count() for k in (1, 2))
    assert slow_kept(texts)[0] == [1]
    assert got_kept(corpus_pipeline.near(spark, frame(spark, texts.items()), "")) == [1, 3]


@pytest.mark.parametrize("distance", [2, 3])
def test_fingerprints_alone(spark, monkeypatch, distance):
    """Without prefixes the stage links just the similar documents of each class of close fingerprints."""
    monkeypatch.setattr(jaccard, "_buckets", no_buckets)
    monkeypatch.setattr(jaccard, "fingerprint_classes", partial(jaccard.fingerprint_classes, distance=distance))
    texts = copies(6)
    of, links = slow_classes(texts, distance), slow_kept(texts)[1]
    near = [(a, b) for a, b in links if of[a] == of[b]]
    assert 20 < len(near) < len(links)
    assert got_kept(corpus_pipeline.near(spark, frame(spark, texts.items()), "")) == sorted(set(slow_components(texts, near).values()))


@pytest.mark.parametrize(("distance", "most"), [(2, 1024), (3, 2), (5, 1024)])
def test_prefixes_do_the_rest(spark, monkeypatch, distance, most):
    """However much fingerprints settle, together with prefixes no link is lost; prefixes leave out what is settled."""
    monkeypatch.setattr(jaccard, "fingerprint_classes", partial(jaccard.fingerprint_classes, distance=distance, most=most))
    texts = copies(7)
    assert got_kept(corpus_pipeline.near(spark, frame(spark, texts.items()), "")) == slow_kept(texts)[0]


def test_settled_pairs_are_left_out():
    sets = [np.arange(k, 1000 + k, dtype=np.uint64) << np.uint64(54) for k in range(4)]
    ids, sizes, bits = np.arange(4), np.array([1000] * 4), [jaccard.sketch(s) for s in sets]
    assert len(jaccard.candidates(ids, sizes, bits)) == 3
    assert jaccard.candidates(ids, sizes, bits, np.array([7, 7, 7, 7])) == []
    assert all((a < 2) != (b < 2) for a, b in jaccard.candidates(ids, sizes, bits, np.array([7, 7, 8, 8])))


def test_classes_of_fingerprints(spark):
    """Classes of more than `most` sets are left to the prefixes; equal sets are one."""
    texts = {i: t for i, t in copies(8).items() if t and len(t.split()) > 5}
    docs = frame(spark, texts.items()).selectExpr("doc_id AS __id", "text AS __text")
    rows = jaccard.with_prefixes(docs, np.array([], np.uint64)).cache()
    fp, of = {r["__id"]: r["__fp"] for r in rows.collect()}, slow_classes(texts, 3)
    members = {}
    for i, c in of.items():
        members.setdefault(c, set()).add(fp[i])
    for most in (3, 1024):
        got = {}
        for r in jaccard.fingerprint_classes(rows, most=most).collect():
            got.setdefault(r["class"], set()).add(r.fp)
        assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if 2 <= len(m) <= most)
    rows.unpersist()
