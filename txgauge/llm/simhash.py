"""SimHash near-dedup with the generalised pigeonhole principle.

Equal fingerprints are one node. Bits that occur together are grouped into partitions; thresholds t_i >= -1 that sum
to (links' distance) - (partitions) + 1 are dealt to them by dynamic programming over estimated candidate counts,
from bit statistics of all fingerprints. Two fingerprints within the distance agree, within t_i, on some partition i:
each is put under its value there (t = 0), or under that value with any one or two bits left out.

A bucket of more than SMALL fingerprints is never paired within: its remaining bits are cut into one part more than
the distance, of which one must agree, and the bucket splits by each part. Fingerprints are distinct, so few remaining
bits mean few fingerprints and this ends. Small buckets are verified pair by pair, and a spanning forest of their
links is all that leaves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import cut, from_texts
from txgauge.llm.components import components

BITS, SMALL, BLOCK = 64, 128, 1 << 18


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64 bits; 0 without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(len(x) + 1 for x in w))
    n, ones = len(w) - words + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at : min(at + BLOCK, n)], ends[at + words - 1 :], strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes: the fingerprint of a set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", name: str = "__fp") -> DataFrame:
    """docs, but the text, with the fingerprint as a signed long; null text is empty and has fingerprint 0."""


    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))]

    return from_texts(docs, F.col(text_col), [c for c in docs.columns if c != text_col], f"{name} long", start)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << b for b in bits)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for all pairs of bits in how many both are set; each partition gives 4,096 sums."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for d in batches:
            x = np.unpackbits(d["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T.astype(np.float64) @ x
            n += len(x)
        yield pd.DataFrame({"k": np.arange(BITS * BITS + 1), "c": np.append(total.ravel(), n).astype(np.int64)})

    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in fps.mapInPandas(sums, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[r["k"]] = r["c"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits: each starts with the bit most correlated to the rest and takes those most so to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    r = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (r[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def deal_thresholds(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """(cost, thresholds): rows put into buckets plus expected pairs that share one, least over all allocations."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for g in groups:
        at = np.array([1.0] + [0.0] * distance)  # at[d]: probability of d differing bits
        for b in g:
            at = at * (1 - differ[b]) + np.append(0, at[:-1]) * differ[b]
        costs.append([0.0] + [n * comb(len(g), t) + n * n / 2 * at[: t + 1].sum() * comb(len(g), t) ** 0.5 for t in range(distance + 1)])
    target = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, dealt) in best.items():
            for t in range(-1, distance + 1):
                if s + t not in new or cost + c[t + 1] < new[s + t][0]:
                    new[s + t] = (cost + c[t + 1], [*dealt, t])
        best = new
    return best[target]


def plan_partitions(n: int, both: np.ndarray, distance: int) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of the cheapest number of groups, 1 to 8."""
    found = []
    for m in range(1, 9):
        groups = group_bits(n, both, m)
        cost, dealt = deal_thresholds(n, both, groups, distance)
        found.append((cost, m, groups, dealt))
    _, _, groups, dealt = min(found, key=lambda x: x[:2])
    return groups, dealt


def forest(values: Sequence[int], distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the values, at most SMALL or so of them."""
    v = np.unique(np.asarray(values, dtype=np.int64)).view(np.uint64)
    if len(v) < 2:
        return []
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= distance
    label = np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    s = v.view(np.int64)
    return [(int(s[k]), int(s[i])) for i, k in enumerate(label.tolist()) if i != k]


def linked(fps: DataFrame, distance: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b): edges that connect just what links of at most `distance` differing bits among the distinct fp connect."""
    n, both = bit_statistics(fps)
    groups, dealt = plan_partitions(n, both, distance)
    every = (1 << BITS) - 1
    paths: list[int] = []  # by path: the bits that may still differ
    keys: list[Column] = []
    for g, t in zip(groups, dealt, strict=True):
        for out in combinations(g, t) if t >= 0 else ():
            kept = _mask(g) & ~_mask(out)
            keys.append(F.struct(F.lit(len(paths)).alias("path"), F.xxhash64(F.lit(len(paths)), F.col("fp").bitwiseAND(_signed(kept))).alias("key")))
            paths.append(every & ~kept)
    level = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.path", "k.key")
    edges = None

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def solve(members: pd.Series) -> pd.Series:
        return pd.Series([forest(m, distance) for m in members])

    while True:
        sizes = cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        hot_bound = sizes.agg(F.max("n")).first()[0] or 0
        in_small = level.join(sizes.filter(F.col("n") <= small).select("key"), "key")
        own = in_small.groupBy("key").agg(F.collect_list("fp").alias("members")).select(F.explode(solve("members")).alias("e")).select("e.a", "e.b")
        edges = own if edges is None else edges.union(own)
        if hot_bound <= small:
            return edges
        hot = level.join(sizes.filter(F.col("n") > small).select("key"), "key")
        parts, nexts, base = [], [], len(paths)
        for rest in paths:
            bits = [b for b in range(BITS) if rest >> b & 1]
            cuts = [bits[i :: distance + 1] for i in range(distance + 1)]
            parts.append([_signed(_mask(c)) for c in cuts])
            nexts += [rest & ~_mask(c) for c in cuts]
        lookup = F.element_at(F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts]), F.col("path") + 1)
        k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(
            (F.col("path") * (distance + 1) + i).alias("path"),
            F.xxhash64(F.lit(base), F.col("key"), i, F.col("fp").bitwiseAND(F.get(lookup, i))).alias("key"))))
        level = cut(hot.select("fp", k.alias("k")).select("fp", "k.path", "k.key"))
        paths = nexts


def near_groups(rows: DataFrame, id_cols: Sequence[str], distance: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """rows (id columns, __fp) with __min: the struct of the id columns that is smallest in the row's component.

    Components are those of `edges` (a, b) between the __fp, by default of links within the distance.
    """
    nodes = cut(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.struct(*id_cols)).alias("least")))
    roots = components(linked(nodes.select("fp"), distance) if edges is None else edges)
    known = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    best = known.groupBy("root").agg(F.min("least").alias("__min"))
    by_fp = known.select("fp", "root").join(best, "root").select("fp", "__min")
    return rows.join(by_fp, F.col("__fp") == F.col("fp")).drop("fp")


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id of the component.

    Null ids count as larger than any other; component_id is null only where all are. Repeated rows are linked, as
    are all texts without words (fingerprint zero). An empty table gives an empty result.
    """
    rows = with_fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), words, "__text")
    rows = cut(rows.withColumn("__none", F.col("__id").isNull()))
    out = near_groups(rows, ["__none", "__id"], distance)
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__min.__id").alias("component_id"))


def keep_one(docs: DataFrame, distance: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that have a smaller row, by id and then by hash of the text, in their component.

    Rows equal in id and text stay or go together.
    """
    h = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).isNull().alias("__none"), F.col(id_col).alias("__id"), h.alias("__h"), F.col(text_col).alias("__text"))
    rows = cut(with_fingerprints(rows, words, "__text"))
    ids = ["__none", "__id", "__h"]
    gone = near_groups(rows, ids, distance).filter(~F.struct(*ids).eqNullSafe(F.col("__min"))).select("__id", "__h").distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left_anti")


def keep_similar(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keep_one for links of Jaccard similarity 0.8 or more between sets of word shingles, none of which is lost.

    Fingerprints within jaccard.DISTANCE bits, found by `linked`, propose the nearest pairs. Similar texts can differ in
    more bits, and to probe that far partitions of so few bits would be needed that all fingerprints share buckets: what
    fingerprints do not settle is proposed by prefixes of the sets. All proposed pairs are verified by their sets.
    """
    from txgauge.llm import jaccard

    return jaccard.keep_one(docs, words, id_col, text_col)
