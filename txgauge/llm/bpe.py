"""Byte-level BPE encoding and decoding with tiktoken and a rank file on the local disk of every machine.

Long texts are cut before encoding, only where white space follows another character: no match of the split pattern
spans such a place and the matches after it do not depend on what stands before, so the pieces encode as the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.llm.common import from_texts, others

PIECE = 1 << 16
_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")  # the pattern's own class: re's differs


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(hashlib.sha1(path.encode()).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """text in pieces of at least size characters (but the last), cut at safe places only."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m or m.start() == len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Token ids, little-endian unsigned 32-bit."""
    parts = [np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with token_ids (little-endian unsigned 32-bit integers in a binary) and decoded (bytes of those ids).

    Null text counts as empty and has no ids. No special tokens are added or recognised. Only the columns in keep
    stay, by default all. Input columns named token_ids or decoded, in any case, are replaced; an empty table gives an empty result.
    A worker holds one batch of texts and the ids of a few MB of them.
    """
    free = others(docs, ("token_ids", "decoded"))
    columns = free if keep is None else [c for c in keep if c in free]

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        enc = encoding(path, pattern)

        def make(texts: list[str | None]) -> list[pa.Array]:
            ids = [encode(enc, t or "") for t in texts]
            return [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([enc.decode_bytes(i.tolist()) for i in ids], pa.binary())]

        return make

    return from_texts(docs, F.col(text_col), columns, "token_ids binary, decoded binary", start)
