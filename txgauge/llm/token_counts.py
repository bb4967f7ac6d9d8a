"""Token counts of a SentencePiece BPE model by rank-synchronous merging of ragged arrays.

The normalised text is cut into pre-tokens only between symbols that no piece of the vocabulary joins, so every merge
stays within one. Pre-tokens not seen before are held together as one ragged numpy array; in each round every
sequence merges its pair of lowest rank (the leftmost of equals), all sequences at once, until none has a pair; the
symbols that survive are counted, those outside the vocabulary as their UTF-8 bytes. One merge a round and sequence
gives the library's order, also where a merge creates a pair of lower rank. Sequences too long for rounds are merged
with a heap in the same order.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import from_texts, others

MARK = "▁"
LONG = 256
#: Counts kept from one batch to the next, in each Python worker.
KEPT = 1 << 20


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            x = b[i]
            i += 1
            v |= (x & 127) << s
            s += 7
            if x < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, b[i : i + n]
            i += n


class PieceModel:
    """What counting needs of a .model file; raises on models whose rules it does not follow."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        pieces = []
        for _, v in (x for x in parts if x[0] == 1):
            d = dict(_fields(v))
            pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, 1)))
        trainer = dict(_fields(next(v for k, v in parts if k == 2)))
        norm = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        own = [(p, s) for p, s, kind in pieces if kind == 1]
        if trainer.get(3) != 2 or not trainer.get(35) or any(kind in (4, 5) for *_, kind in pieces) or norm.get(2) or norm.get(4, 1):
            raise ValueError(f"{path}: not a BPE model with byte fallback, identity normaliser and kept white space")
        self.dummy_prefix = bool(norm.get(3, 1))
        order = {p: i for i, (p, _) in enumerate(sorted(own, key=lambda x: -x[1]))}
        rank_of_score = {s: i for i, s in enumerate(sorted({s for _, s in own}, reverse=True))}
        self.symbols = {p: i for i, p in enumerate(order)}
        score = dict(own)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        joined = set()
        for p in order:
            joined.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (len(a) == 1 or a in score) and (len(b) == 1 or b in score):
                    self.pairs[self._id(a), self._id(b)] = (rank_of_score[score[p]], self._id(p))
        self.known = np.zeros(len(self.symbols), bool)
        self.known[[self.symbols[p] for p in order]] = True
        keys = np.array(sorted(a << 32 | b for a, b in self.pairs), dtype=np.int64)
        self.keys = keys
        self.ranks, self.merged = np.array([self.pairs[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in keys], dtype=np.int64).reshape(-1, 2).T.copy()
        self.joined = joined
        self.after_other = any(b == MARK and a != MARK for a, b in joined)
        lone = [c for c in "\n\t\r" if not any(c in x for x in joined)]
        cls = "".join(map(re.escape, lone))
        self.lone = frozenset(lone)
        self.split = re.compile(rf" *[^ {cls}]+|[{cls}]| +" if lone else r" *[^ ]+| +") if not self.after_other else None
        self.cache: dict[str, int] = {}

    def _id(self, piece: str) -> int:
        return self.symbols.setdefault(piece, len(self.symbols))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.cache) > KEPT:
            self.cache.clear()
        cache, split = self.cache, self.split
        seen = []
        for t in texts:
            t = t.replace(MARK, " ")  # the library writes spaces as this mark, so the two are one symbol
            t = (" " + t) if self.dummy_prefix and t else t
            seen.append(split.findall(t) if split else [t])
        new = list({w for words in seen for w in words if w not in cache})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            cache.update(zip(part, self._merge(part), strict=True))
        get = cache.__getitem__
        return [sum(map(get, words)) for words in seen]

    def _merge(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        words = [w.replace(" ", MARK) for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = sum(self._heap(p) for p in self._parts(w))
        lengths = np.array([len(words[i]) for i in short], np.int64)
        if not len(lengths):
            return out.tolist()
        text = "".join(words[i] for i in short)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        alphabet, where = np.unique(points, return_inverse=True)
        n = len(self.symbols)
        own = np.array([self.symbols.get(chr(c), n + i) for i, c in enumerate(alphabet)], np.int64)
        width = np.where(alphabet < 0x80, 1, np.where(alphabet < 0x800, 2, np.where(alphabet < 0x10000, 3, 4)))
        cost = np.where([x < n and bool(self.known[x]) if x < len(self.known) else False for x in own], 1, width)
        sym, seq, price = own[where], np.repeat(np.arange(len(short)), lengths), cost[where]
        ends = np.zeros(len(short), np.int64)
        while len(sym):
            # the rank of every pair within a sequence, and where each sequence has its lowest
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            live = np.flatnonzero(fits)
            if not len(live):
                break
            code = self.ranks[at[live]] << 32 | live
            owner = seq[live]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(code, starts) & 0xFFFFFFFF
            sym[best] = self.merged[at[best]]
            price[best] = 1
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            # sequences without a pair are done
            active = np.zeros(len(short), bool)
            active[owner[starts]] = True
            done = keep & ~active[seq]
            ends += np.bincount(seq[done], price[done], len(short)).astype(np.int64)
            keep &= active[seq]
            sym, seq, price = sym[keep], seq[keep], price[keep]
        ends += np.bincount(seq, price, len(short)).astype(np.int64)
        out[short] = ends
        return out.tolist()

    def _parts(self, word: str) -> list[str]:
        """word, cut between characters that no piece joins."""
        cuts = [i for i, p in enumerate(zip(word, word[1:], strict=False), 1) if p not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _heap(self, word: str) -> int:
        n = len(word)
        sym = [self.symbols.get(c, -1) for c in word]
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        stamp = [0] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (m := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(heap, (m[0], i, stamp[i], stamp[j]))

        for i in range(n - 1):
            push(i)
        merged = set()
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or stamp[i] != a or stamp[j] != b:
                continue
            sym[i] = self.pairs[sym[i], sym[j]][1]
            alive[j] = False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            stamp[i] += 1
            stamp[j] += 1
            merged.add(i)
            if left[i] >= 0:
                push(left[i])
            push(i)
        return sum(1 if i in merged or (0 <= sym[i] < len(self.known) and self.known[sym[i]]) else len(word[i].encode("utf-8", "surrogatepass")) for i in range(n) if alive[i])


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Input columns with the added names, in any case, are replaced; an empty table
    gives an empty result.
    """


    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        m = model(path)

        def make(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([x for at in range(0, len(texts), 256) for x in m.count([t or "" for t in texts[at : at + 256]])], pa.int64())]

        return make

    counted = from_texts(docs, F.col(text_col), others(docs, ("n_bytes", "n_tokens", "over_limit")), "n_bytes long, n_tokens long", start)
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
