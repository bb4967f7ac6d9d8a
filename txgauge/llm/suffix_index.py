"""Removal of passages that occur again, by a logarithmic family of sparse suffix arrays.

A byte goes if a string of LENGTH bytes over it also starts elsewhere. Full suffix arrays hold eight bytes for each
byte of text; these hold only the suffixes at anchors: the leftmost smallest of the hashes of all GRAM-byte strings
in a window of LENGTH bytes. Equal windows have their anchor at the same place, so the suffixes at their anchors agree
on GRAM bytes or more and are neighbours in the arrays.

An array is ordered by the suffixes' first eight bytes, as text, and further by the hash of their first GRAM bytes; it
is dealt into buckets by both, so two arrays are merge-scanned bucket by bucket, without an exchange. An entry stands
for all windows of one anchor: with its suffix go a hash of the block of bytes that its windows cover and how often
that block occurs. Documents come in batches. Each batch gets its array, is merge-scanned against the existing levels
for suffixes that both have, and joins them as a level; two levels of equal size merge, equal blocks becoming one
entry. Blocks that occur twice are removed as they are. Where suffixes agree on GRAM bytes and blocks differ, the
windows themselves are compared, aligned at the anchor: first by hash, and what that finds byte by byte.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import filled, folder, others, release, shuffle_partitions, written

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # hashes in a window
LEFT = SPAN - 1  # most bytes of a window before its anchor
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 24  # of a position within a run of text
_RUN, _BIG = 1 << 21, 1 << 23
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place."""
    t, s = _TABLE[b], 1
    while s < GRAM:
        t = t[:-s] * _power(s) + t[s:]
        s *= 2
    t = (t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return t ^ (t >> np.uint64(32))


def window_anchors(t: np.ndarray) -> np.ndarray:
    """For every window the place of its smallest hash, the leftmost of equals."""
    low = np.uint64((1 << _BITS) - 1)
    v, s = (t & ~low) | np.arange(len(t), dtype=np.uint64), 1
    while 2 * s <= SPAN:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    v = np.minimum(v[: len(t) - SPAN + 1], v[SPAN - s :])
    return (v & low).astype(np.int64)


def entries(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(index of the text, anchor, first and last window, first eight bytes as an ordered number, hash, block hash) of all anchors of texts, joined in one run."""
    sizes = np.array([len(x) for x in texts])
    joined = b"".join(texts)
    b = np.frombuffer(joined, np.uint8)
    if len(b) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    t = gram_hashes(b)
    at = window_anchors(t)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= ends[owner]
    starts = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    lasts = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], True])
    digest = xxhash.xxh3_64_intdigest
    anchor, own = at[starts], owner[starts]
    block = np.array([digest(joined[a : z + LENGTH], c - a) for a, z, c in zip(starts.tolist(), lasts.tolist(), anchor.tolist(), strict=True)], dtype=np.uint64)
    base = (ends - sizes)[own]
    first = np.zeros(len(anchor), np.uint64)
    for i in range(8):
        first = first << np.uint64(8) | b[anchor + i].astype(np.uint64)
    ordered = (first ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the order of the bytes
    return own, anchor - base, starts - base, lasts - base, ordered, t[anchor].view(np.int64), block.view(np.int64)


def _runs(d: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Entries of a batch of documents, in runs of a few MB; texts of many MB are cut with an overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> pd.DataFrame:
        own, *rest = entries([x[2] for x in held])
        row, shift = np.array([x[0] for x in held])[own], np.array([x[1] for x in held])[own]
        a, lo, hi, k, h, t = rest
        return pd.DataFrame({"id": d["id"].to_numpy()[row], "x": d["x"].to_numpy()[row], "k": k, "h": h, "t": t, "p": (a + shift) << 16 | (a - lo) << 8 | (hi - lo)})

    for i, text in enumerate(d["text"]):
        raw = (text or "").encode("utf-8", "replace")
        for at in range(0, max(len(raw) - LENGTH + 1, 0), _BIG):
            part = raw[at : at + _BIG + LENGTH - 1]
            if held and size + len(part) > _RUN:
                yield flush()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield flush()


def anchor_entries(docs: DataFrame) -> DataFrame:
    """Entries of documents (id, x, text); p packs the anchor, its first window before it, and the number of windows more."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield from _runs(d)

    return docs.mapInPandas(run, f"id {kind}, x long, k long, h long, t long, p long")


class SuffixIndex:
    """Levels of merged batches: level i holds 2**i of them, as (k, h, t, n) ordered by suffix, n being how often the block occurs."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.levels: dict[int, DataFrame] = {}
        self.hits: list[DataFrame] = []
        self.names: list[str] = []

    def _array(self, rows: DataFrame) -> DataFrame:
        """rows in their buckets, in order, as a table in the checkpoint folder."""
        spark, name = rows.sparkSession, f"suffixes_{uuid.uuid4().hex}"
        way = rows.repartition(self.buckets, "k", "h").sortWithinPartitions("k", "h", "t").write.bucketBy(self.buckets, "k", "h").sortBy("k", "h", "t")
        way.option("path", f"{folder(spark)}/{name}").saveAsTable(name)
        self.names.append(name)
        return spark.table(name)

    @staticmethod
    def _rows(array: DataFrame) -> DataFrame:
        """An array without its buckets: a union of bucketed tables may be taken for bucketed itself, which it is not."""
        files = array.inputFiles()
        return array.sparkSession.read.schema(array.schema).parquet(os.path.dirname(files[0])) if files else array.sparkSession.createDataFrame([], array.schema)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k", "h", "t").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Index the entries of a batch and note the suffixes found again, in it or in a level."""
        # equal blocks are one row before the buckets are dealt, so that a frequent one does not fill a bucket
        new = self._array(self._merged(batch.select("k", "h", "t", F.lit(1).cast("long").alias("n"))))
        self.hits.append(written(new.groupBy("k", "h").agg(F.sum("n").alias("n")).filter("n > 1").select("k", "h"), "hits"))
        for level in self.levels.values():
            self.hits.append(written(new.select("k", "h").join(level.select("k", "h"), ["k", "h"], "left_semi"), "hits"))
        rank = 0
        while rank in self.levels:
            old = [self.levels.pop(rank), new]
            new = self._array(self._merged(self._rows(old[0]).union(self._rows(old[1]))))
            release(new.sparkSession, *old)
            rank += 1
        self.levels[rank] = new

    def repeated(self) -> DataFrame:
        """(h, t, n, kinds) of what may repeat: blocks that occur again, and suffixes with several kinds of block."""
        every = reduce(DataFrame.union, map(self._rows, self.levels.values()))
        again = written(reduce(DataFrame.union, self.hits).distinct(), "again")
        merged = written(self._merged(every.join(again, ["k", "h"], "left_semi").select("k", "h", "t", "n")), "merged")
        # joined from written tables, so that Spark can split the rows of a suffix that is very frequent
        kinds = written(merged.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
        out = merged.join(kinds, "h", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long")))
        out = written(out.filter("n > 1 or kinds > 1").select("h", "t", "n", "kinds"), "repeated")
        release(out.sparkSession, again, merged, kinds, *self.hits, *self.levels.values())
        for name in self.names:
            out.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.hits, self.names = {}, [], []
        return out


def _aligned(block: pd.Series, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes in columns aligned at the anchor, and the first column and the number of each one's windows."""
    m, size = np.zeros((len(block), LEFT + LENGTH), np.uint8), np.array([len(b) for b in block])
    for i, (b, o) in enumerate(zip(block, offset.tolist(), strict=True)):
        m[i, LEFT - o : LEFT - o + len(b)] = np.frombuffer(b, np.uint8)
    s = np.arange(LEFT + 1)[None, :]
    first = (LEFT - offset)[:, None]
    return m, (s >= first) & (s <= first + (size - LENGTH)[:, None])


def _hashes(m: np.ndarray) -> np.ndarray:
    """Hash of the window with s - LEFT bytes from the anchor, for all s."""
    h = np.zeros((m.shape[1] + 1, len(m)), np.uint64)
    for j in range(m.shape[1]):
        h[j + 1] = h[j] * _BASE + _TABLE[m[:, j]]
    return (h[LENGTH:] - h[: LEFT + 1] * _power(LENGTH)).T


def _equal(m: np.ndarray, rows: np.ndarray, others: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the windows s of two rows each have the same bytes: each pair of rows is compared once."""
    pairs, at = np.unique(rows * len(m) + others, return_inverse=True)
    out = np.zeros(len(s), bool)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(0, len(pairs) + 4096, 4096))
    for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        mine = order[a:z]
        part = pairs[4096 * k : 4096 * (k + 1)]
        differ = np.cumsum(np.pad(m[part // len(m)] != m[part % len(m)], ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        i = at[mine] - 4096 * k
        out[mine] = differ[i, s[mine] + LENGTH] == differ[i, s[mine]]
    return out


def shared_windows(d: pd.DataFrame) -> pd.DataFrame:
    """(id, x, s, e): byte ranges of windows that another block under the same hash has, of blocks that occur once."""
    d = d.drop_duplicates(["h", "t"])
    m, has = _aligned(d["block"], d["o"].to_numpy())
    w = _hashes(m)
    group = pd.factorize(d["h"])[0].astype(np.uint64)
    place = group[:, None] * np.uint64(LEFT + 1) + np.arange(LEFT + 1, dtype=np.uint64)[None, :]
    mixed = (w ^ (w >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    row, column = np.nonzero(has)
    flat = mixed[has]
    order = np.argsort(flat, kind="stable")
    same = np.flatnonzero(flat[order][1:] == flat[order][:-1])
    one, two = order[same], order[same + 1]
    true = (column[one] == column[two]) & (group[row[one]] == group[row[two]])
    true[true] = _equal(m, row[one[true]], row[two[true]], column[one[true]])
    twice = np.zeros(len(flat), bool)
    if true.all():
        twice[one] = twice[two] = True
    else:  # other windows share a hash: these are told apart by their bytes
        odd = np.isin(flat, flat[one[~true]])
        twice[one[~odd[one]]] = twice[two[~odd[two]]] = True
        seen: dict[tuple, int] = {}
        for i in np.flatnonzero(odd):
            key = (int(group[row[i]]), int(column[i]), m[row[i], column[i] : column[i] + LENGTH].tobytes())
            if key in seen:
                twice[[i, seen[key]]] = True
            seen[key] = i
    hit = np.zeros((len(d), LEFT + 3), np.int8)
    inner = hit[:, 1:-1]
    inner[has] = twice
    edge = np.diff(hit, axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    out = pd.DataFrame({"s": d["a"].to_numpy()[rows] + starts - LEFT, "e": d["a"].to_numpy()[rows] + ends - 1 - LEFT + LENGTH})
    out = out.assign(id=d["id"].to_numpy()[rows], x=d["x"].to_numpy()[rows])
    return out[(d["n"] == 1).to_numpy()[rows]]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """shared_windows over rows sorted by h; the last hash of a batch waits for the next one."""
    held: list[pd.DataFrame] = []
    for d in batches:
        if len(d):
            last = d["h"].iloc[-1]
            done, wait = d[d["h"] != last], d[d["h"] == last]
            if len(done):
                yield shared_windows(pd.concat([*held, done]))
                held = []
            held.append(wait)
    if held:
        yield shared_windows(pd.concat(held))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the bytes of the entries asked for of each document."""
    for d in batches:
        out: list[tuple] = []
        for i, x, text, asked in zip(d["id"], d["x"], d["text"], d["asked"], strict=True):
            raw = text.encode("utf-8", "replace")
            for e in asked:
                a, o, more = e["p"] >> 16, e["p"] >> 8 & 255, e["p"] & 255
                out.append((i, x, e["h"], e["t"], e["n"], a, o, raw[a - o : a - o + more + LENGTH]))
        yield pd.DataFrame(out, columns=["id", "x", "h", "t", "n", "a", "o", "block"])


def _hot_windows(d: pd.DataFrame) -> pd.DataFrame:
    m, has = _aligned(d["block"], d["o"].to_numpy())
    w = _hashes(m)
    rows, s = np.nonzero(has)
    return d.iloc[rows][["id", "x", "h", "t", "n", "a"]].assign(s=s, w=w[rows, s].view(np.int64))


def repeated_ranges(docs: DataFrame, batches: int = 7, most_kinds: int = 20_000) -> DataFrame:
    """(id, x, starts, ends): byte ranges to be removed from documents (id, x, text); x is a hash of the text.

    Seven batches leave levels of four, two and one of them. Suffixes with more than most_kinds blocks are not held in
    one task: their windows are dealt out one by one.
    """
    kind = docs.schema["id"].dataType.simpleString()
    found = anchor_entries(docs).withColumn("batch", F.pmod(F.xxhash64("id", "x"), F.lit(batches)).cast("int"))
    found = written(found, "anchors", "batch")
    index = SuffixIndex(shuffle_partitions(docs.sparkSession))
    for b in range(batches):
        index.add(found.filter(F.col("batch") == b))
    again = index.repeated()
    mine = written(found.drop("batch", "k").join(again, ["h", "t"]), "again")
    release(docs.sparkSession, found, again)
    first = (F.shiftright("p", 16) - F.shiftright("p", 8).bitwiseAND(255)).alias("s")
    whole = mine.filter("n > 1").select("id", "x", first, (first + F.col("p").bitwiseAND(255) + LENGTH).alias("e"))
    mixed = mine.filter("kinds > 1").groupBy("h", "t", "n").agg(F.min(F.struct("id", "x", "p")).alias("w"))
    asked = mixed.groupBy(F.col("w.id").alias("__i"), F.col("w.x").alias("__x")).agg(F.collect_list(F.struct("h", "t", "n", "w.p")).alias("asked"))
    texts = docs.join(asked, F.col("id").eqNullSafe(F.col("__i")) & (F.col("x") == F.col("__x"))).select("id", "x", "text", "asked")
    blocks = texts.mapInPandas(_blocks, f"id {kind}, x long, h long, t long, n long, a long, o long, block binary")
    ranges = f"s long, e long, id {kind}, x long"
    hot = mine.filter(F.col("kinds") > most_kinds).select("h").distinct()
    done: list[DataFrame] = []
    if hot.isEmpty():
        shared = blocks.repartition("h").sortWithinPartitions("h").mapInPandas(_solve, ranges)
    else:
        blocks = written(blocks, "blocks")
        shared = blocks.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInPandas(_solve, ranges)
        one = blocks.join(hot, "h", "left_semi").select(*blocks.columns).dropDuplicates(["h", "t"])
        one = written(one.mapInPandas(lambda it: (_hot_windows(d) for d in it), f"id {kind}, x long, h long, t long, n long, a long, s long, w long"), "windows")
        done = [blocks, one]
        two = one.groupBy("h", "s", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
        start = F.col("a") + F.col("s") - LEFT
        shared = shared.union(one.filter("n = 1").join(two, ["h", "s", "w"], "left_semi").select(start, start + LENGTH, "id", "x"))
    shared = written(shared.toDF("s", "e", "id", "x"), "shared")
    release(docs.sparkSession, *done)
    every = whole.union(shared.select("id", "x", "s", "e"))
    near = every.groupBy("id", "x").agg(F.collect_set(F.struct("s", "e")).alias("r"))
    return near.select("id", "x", F.col("r.s").alias("starts"), F.col("r.e").alias("ends"))


def _removed(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:size] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes, in a binary).

    Null text counts as empty. Repeated rows are each other's repeats. Texts are judged on the input; kept need not
    be valid UTF-8. Null ids are one more id. Input columns with the added names, in any case, are replaced; an
    empty table gives an empty result.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(filled(F.col(text_col))).alias("x"), filled(F.col(text_col)).alias("text"))
    ranges = repeated_ranges(keys.filter(F.octet_length("text") >= LENGTH), **how).withColumnsRenamed({"id": "__i", "x": "__x"})
    columns = others(docs, added)
    d = docs.select(*columns, filled(F.col(text_col)).alias("__text"))
    d = d.join(ranges, F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64("__text") == F.col("__x")), "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def apply(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for x, s, e in zip(text, starts, ends, strict=True):
            raw = x.encode("utf-8", "replace")
            if s is None:
                out.append((len(raw), 0, 0, raw))
                continue
            gone = _removed(len(raw), np.asarray(s), np.asarray(e))
            spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
            out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return d.select(*columns, apply("__text", "starts", "ends").alias("__r")).select(*columns, *[f"__r.{c}" for c in added])
