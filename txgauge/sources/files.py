"""Plain and gzip files, told apart by their first bytes."""

from __future__ import annotations

import contextlib
import gzip
import os
import shutil
from collections.abc import Iterator
from pathlib import Path
from typing import IO

GZIP = b"\x1f\x8b"
SUFFIXES = (".gzip", ".gz")


def is_gzip(path: str | os.PathLike) -> bool:
    """By the first two bytes, whatever the name; False for what cannot be read."""
    try:
        with open(path, "rb") as f:
            return f.read(2) == GZIP
    except OSError:
        return False


def is_packed(path: str | os.PathLike) -> bool:
    """Packed by content, or named so that readers which go by the name would unpack it."""
    return is_gzip(path) or Path(path).suffix.lower() in (*SUFFIXES, ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def open_bytes(path: str | os.PathLike) -> IO[bytes]:
    return gzip.open(path, "rb") if is_gzip(path) else open(path, "rb")


def open_text(path: str | os.PathLike) -> IO[str]:
    return gzip.open(path, "rt") if is_gzip(path) else open(path)


def without_gzip_suffix(path: str | os.PathLike) -> Path:
    """The path without one .gz or .gzip at its end, in either case."""
    p = Path(path)
    return next((p.with_name(p.name[: -len(s)]) for s in SUFFIXES if p.name.lower().endswith(s) and len(p.name) > len(s)), p)


@contextlib.contextmanager
def plain_copy(path: str | os.PathLike, folder: str | os.PathLike) -> Iterator[Path]:
    """The file itself, or an unpacked copy in folder that goes when the block ends, however it ends."""
    if not is_gzip(path):
        yield Path(path)
        return
    to = Path(folder) / without_gzip_suffix(path).name
    if to.exists():
        raise FileExistsError(f"{to} is there already")
    try:
        with open_bytes(path) as f, open(to, "xb") as g:
            shutil.copyfileobj(f, g, 1 << 20)
        yield to
    finally:
        to.unlink(missing_ok=True)
