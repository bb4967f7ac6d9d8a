"""Near-dedup by exact Jaccard similarity of word shingles: SimHash proposes, prefixes of the sets do for the rest.

SimHash fingerprints of the documents' sets of words are probed by the generalised pigeonhole principle; documents that
links of at most DISTANCE bits connect are a class. A class of up to MOST documents is a bucket, in which all its pairs
are looked at. Pairs of no such class are found exactly by a set-similarity join:

Sets whose Jaccard similarity is SIMILAR or more share that part of the larger one's elements, so under any common
order of all shingles they share one of each set's first few (a fifth and one): no pair is lost by looking only there.
Shingles are ordered by hash. Documents that share a shingle with more than SMALL others are looked at again among
themselves with such shingles ordered last, so that what is common to many groups them only where little else is left.

Documents under one shingle are a bucket too. A bucket's pairs are candidates unless their sizes or sketches are too far
apart: each document carries four bits of the smallest shingle in each of BINS ranges of hashes, and two sets of
similarity J agree in about J of the ranges that either has. Pairs that agree in fewer than LEAST of them are left out; a
similar pair would do so with a chance of 3e-10 at most. Full sets are held once, by component of the candidates; in it
all pairs that are not connected yet are verified, and a spanning forest of their links is all that leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.llm import simhash
from txgauge.llm.common import cut, from_texts, release
from txgauge.llm.components import components
from txgauge.session import small

WORDS, SMALL, ROUNDS, BINS, LEAST = 5, 128, 3, 256, 0.64
DISTANCE, MOST = 3, 1024  # bits between fingerprints, and documents of a class that is one bucket
SIMILAR = (4, 5)  # least similarity, as a fraction
_MOST_LAST = 1 << 16  # shingles that one round orders last: affects speed only
_ROWS, _COLS = 1024, 4096  # of the blocks that are multiplied
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def word_hashes(text: str | None) -> np.ndarray:
    w = (text or "").encode("utf-8", "replace").lower().split()  # as in simhash.fingerprint
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def runs(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; a shorter text is one run, even without words."""
    size = min(words, len(h))
    n = len(h) - size + 1 if size else 1
    out = np.full(n, size + 1, np.uint64)
    for i in range(size):
        out = _mixed(out * _TABLE[i] + h[i : i + n])
    return np.unique(out)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return runs(word_hashes(text), words)


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles, of which similar sets share one; those in `last` come after all others."""
    a, b = SIMILAR
    if len(last):
        behind = np.isin(s, last)
        s = np.concatenate([s[~behind], s[behind]])
    return s[: len(s) - -(-len(s) * a // b) + 1]


def sketch(s: np.ndarray) -> bytes:
    """BINS times four bits: 1 to 15 from the smallest shingle of each range, 0 for a range without any; s is sorted."""
    at = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[at[first]] = _mixed(s[first]) % np.uint64(15) + np.uint64(1)
    return (out[0::2] | out[1::2] << np.uint8(4)).tobytes()


def _marked(x: np.ndarray) -> np.ndarray:
    """The lowest bit of each four, set where any of them is."""
    return (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)


def with_prefixes(docs: DataFrame, last: np.ndarray, words: int = WORDS, text_col: str = "__text") -> DataFrame:
    """docs, but the text, with columns of the set of shingles and __sim, the SimHash fingerprint of the set of words.

    __fp is a hash of the set of shingles, __keys its prefix, __bits its sketch.
    """


    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        def make(texts: list[str | None]) -> list[pa.Array]:
            hashes = [word_hashes(t) for t in texts]
            sets = [runs(h, words) for h in hashes]
            sims = np.array([simhash.majority(runs(h, 1)) for h in hashes], dtype=np.uint64).view(np.int64)
            keys = [prefix(s, last).view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            return [pa.array(fps), pa.ListArray.from_arrays(ends, np.concatenate(keys)), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(sims)]

        return make

    return from_texts(docs, F.col(text_col), [c for c in docs.columns if c != text_col], "__fp long, __keys array<long>, __size long, __bits binary, __sim long", start)


def _connected(ids: np.ndarray, near_of: Callable[[int, int, int, int], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest; near_of(i, i1, j, j1) tells which of i to i1 are linked to which of j to j1."""
    m, edges = len(ids), []
    label = np.arange(m)
    for i in range(0, m, _ROWS):
        for j in range(i, m, _ROWS):
            i1, j1 = min(i + _ROWS, m), min(j + _ROWS, m)
            if (label[i:i1] == label[i]).all() and (label[j:j1] == label[i]).all():
                continue
            near = near_of(i, i1, j, j1)
            for r in np.flatnonzero(near.any(axis=1)):
                with_r = j + np.flatnonzero(near[r])
                labels, firsts = np.unique(label[with_r], return_index=True)
                own = label[i + r]
                edges += [(int(ids[i + r]), int(ids[with_r[f]])) for x, f in zip(labels, firsts, strict=True) if x != own]
                if (labels != own).any():
                    label[np.isin(label, labels)] = own
    return edges


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between similar sets, which are sorted and distinct."""
    a, b = SIMILAR
    sizes = np.array([len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    col = np.where(shared, np.cumsum(shared) - 1, -1)[col]
    cols = [np.sort(c[c >= 0]) for c in np.split(col, np.cumsum(sizes)[:-1])]
    width = int(shared.sum())

    def dense(i: int, j: int, k: int) -> np.ndarray:
        out = np.zeros((j - i, min(_COLS, width - k)), np.float32)
        for r, c in enumerate(cols[i:j]):
            out[r, c[np.searchsorted(c, k) : np.searchsorted(c, k + _COLS)] - k] = 1
        return out

    def near_of(i: int, i1: int, j: int, j1: int) -> np.ndarray:
        both = np.zeros((i1 - i, j1 - j), np.float32)
        for k in range(0, width, _COLS):
            both += dense(i, i1, k) @ dense(j, j1, k).T
        both = both.astype(np.int64)
        return b * both >= a * (sizes[i:i1, None] + sizes[None, j:j1] - both)

    return _connected(ids, near_of)


def candidates(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs that may be similar by their sizes and sketches.

    Pairs of one value of `settled` are left out: they are looked at elsewhere.
    """
    if settled is not None and (settled == settled[0]).all():
        return []
    a, b = SIMILAR
    v = np.frombuffer(b"".join(bits), np.uint64).reshape(len(ids), -1)

    has = _marked(v)

    def near_of(i: int, i1: int, j: int, j1: int) -> np.ndarray:
        differ = np.zeros((i1 - i, j1 - j), np.int64)
        either = np.zeros((i1 - i, j1 - j), np.int64)
        for k in range(v.shape[1]):
            differ += np.bitwise_count(_marked(v[i:i1, None, k] ^ v[None, j:j1, k]))
            either += np.bitwise_count(has[i:i1, None, k] | has[None, j:j1, k])
        x, y = sizes[i:i1, None], sizes[None, j:j1]
        near = (differ <= (1 - LEAST) * either) & (b * np.minimum(x, y) >= a * np.maximum(x, y))
        return near if settled is None else near & (settled[i:i1, None] != settled[None, j:j1])

    return _connected(ids, near_of)


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges from (of_class, bucket, fp, size, bits, class) in order of the first two."""
    rows = (r for d in batches for r in zip(d["of_class"], d["bucket"], d["__fp"], d["size"], d["bits"], d["class"], strict=True))
    out: list[tuple[int, int]] = []
    for (of_class, _), members in groupby(rows, key=lambda r: r[:2]):
        known = {r[2]: r[3:] for r in members}
        sizes, bits, classes = zip(*known.values(), strict=True)
        out += candidates(np.array(list(known), np.int64), np.array(sizes), bits, None if of_class else np.array(classes, np.int64))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from (bucket, fp, shingles) in order of the bucket."""
    rows = (r for d in batches for r in zip(d["bucket"], d["fp"], d["shingles"], strict=True))
    for _, members in groupby(rows, key=lambda r: r[0]):
        sets = {fp: np.frombuffer(s, np.uint64) for _, fp, s in members}
        if found := forest(np.array(list(sets), np.int64), list(sets.values())):
            yield pd.DataFrame(found, columns=["a", "b"])


_IDS = ["__none", "__id", "__h"]


def _texts_of(texts: DataFrame, rows: DataFrame, fps: DataFrame) -> DataFrame:
    """texts with one of the fps."""
    asked = cut(rows.join(small(fps, fps.count()), "__fp", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in _IDS]).distinct())
    same = (F.col("__none") == F.col("___none")) & F.col("__id").eqNullSafe(F.col("___id")) & F.col("__h").eqNullSafe(F.col("___h"))
    return texts.join(small(asked, asked.count()), same, "left_semi")


def _buckets(texts: DataFrame, rows: DataFrame, words: int, least_hot: int) -> DataFrame:
    """(bucket, __fp): documents that share a shingle of their prefixes, each group of them once."""
    level, last, buckets = rows.select("__fp", F.explode("__keys").alias("key")), np.array([], np.uint64), None
    for k in range(ROUNDS):
        most = least_hot if k < ROUNDS - 1 else 1 << 62
        sizes = cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        some, hot = sizes.filter(F.col("n") <= most), sizes.filter(F.col("n") > most)
        members = level.join(small(some.select("key"), some.count()), "key").groupBy("key").agg(F.array_sort(F.collect_set("__fp")).alias("fps"))
        own = members.filter(F.size("fps") > 1).select("fps").distinct()
        buckets = own if buckets is None else buckets.union(own)
        keys = [r["key"] for r in hot.orderBy(F.desc("n"), "key").limit(_MOST_LAST).select("key").collect()]
        if not keys:
            break
        last = np.union1d(last, np.array(keys, np.int64).view(np.uint64))
        again = cut(level.join(small(hot.select("key"), hot.count()), "key", "left_semi").select("__fp").distinct())
        level = cut(with_prefixes(_texts_of(texts, rows, again), last, words).dropDuplicates(["__fp"]).select("__fp", F.explode("__keys").alias("key")))
    return cut(buckets.distinct().select(F.xxhash64("fps").alias("bucket"), F.explode("fps").alias("__fp")))


def fingerprint_classes(rows: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(fp, class): classes of two to `most` distinct sets that links of close fingerprints connect."""
    nodes = cut(rows.select(F.col("__fp").alias("fp"), "__sim").dropDuplicates(["fp"]))
    roots = components(simhash.linked(nodes.select(F.col("__sim").alias("fp")).distinct(), distance))
    known = cut(nodes.join(roots, F.col("__sim") == F.col("node"), "left").select("fp", F.coalesce("root", "__sim").alias("root")))
    sizes = known.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("class")).filter(F.col("n").between(2, most))
    return cut(known.join(sizes, "root").select("fp", "class"))


def _candidate_groups(rows: DataFrame, buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, __fp): components of the candidates, of those in classes and of those that only prefixes bring together."""
    known = rows.select(F.col("__fp").alias("fp"), F.col("__size").alias("size"), F.col("__bits").alias("bits")).dropDuplicates(["fp"])
    known = known.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    every = buckets.select(F.lit(False).alias("of_class"), "bucket", "__fp").union(classes.select(F.lit(True), "class", "fp"))
    held = every.join(known, F.col("__fp") == F.col("fp")).select("of_class", "bucket", "__fp", "size", "bits", "class")
    pairs = held.repartition("of_class", "bucket").sortWithinPartitions("of_class", "bucket").mapInPandas(_propose, "a long, b long")
    return cut(components(pairs).select(F.col("root").alias("bucket"), F.col("node").alias("__fp")))


def linked(texts: DataFrame, rows: DataFrame, words: int = WORDS, least_hot: int = SMALL) -> DataFrame:
    """(a, b): edges that connect just what links between similar sets connect.

    texts are (__none, __id, __h, __text), rows the same with what with_prefixes adds instead of the text. What leads
    to a step's result is let go before the next one, so that Spark can drop its shuffles.
    """
    classes = fingerprint_classes(rows)
    release(texts.sparkSession)
    buckets = _buckets(texts, rows, words, least_hot)
    release(texts.sparkSession)
    buckets = _candidate_groups(rows, buckets, classes)
    release(texts.sparkSession)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        def make(texts: list[str | None]) -> list[pa.Array]:
            own = [shingles(t, words).tobytes() for t in texts]
            return [pa.array(np.array([xxhash.xxh64_intdigest(s) for s in own], dtype=np.uint64).view(np.int64)), pa.array(own, pa.binary())]

        return make

    sets = from_texts(_texts_of(texts, rows, buckets.select("__fp").distinct()), F.col("__text"), [], "fp long, shingles binary", start)
    held = buckets.join(sets, F.col("__fp") == F.col("fp")).select("bucket", "fp", "shingles")
    return held.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_solve, "a long, b long")


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", least_hot: int = SMALL) -> DataFrame:
    """The rows of docs without those that have a smaller row, by id and then by hash of the text, in their component.

    Rows equal in id and text stay or go together. Texts without words are similar to each other only.
    """
    h, ids = F.xxhash64(text_col), _IDS
    texts = docs.select(F.col(id_col).isNull().alias("__none"), F.col(id_col).alias("__id"), h.alias("__h"), F.col(text_col).alias("__text"))
    rows = cut(with_prefixes(texts, np.array([], np.uint64), words))
    edges = linked(texts, rows, words, least_hot)
    gone = simhash.near_groups(rows.drop("__keys", "__size", "__bits", "__sim"), ids, edges=edges).filter(~F.struct(*ids).eqNullSafe(F.col("__min"))).select("__id", "__h").distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left_anti")
