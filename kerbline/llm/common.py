"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from ..storage import scratch, settled, shared_dir, stored

__all__ = ["SLAB_BYTES", "mapped", "mix64", "plain_words", "scratch", "settled", "shared_dir", "slabs", "stored", "tidy", "word_hashes"]

SLAB_BYTES = 1 << 20
"""Text handled at once inside a task; a longer text is a slab of its own."""


def slabs(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about limit bytes of column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        slab = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or nothing elsewhere."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end hands its worker's free memory back: workers outlive tasks, and one executor has one a core."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


def mapped(df: DataFrame, column: str, new: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], drop: Collection[str] = (), limit: int = SLAB_BYTES) -> DataFrame:
    """df with the columns that new declares (DDL), computed a slab at a time.

    Columns in drop go, and so does any column of df with a new one's name: the new one takes its place at the end.
    """
    fields = T.StructType.fromDDL(new)
    names = [c for c in df.columns if c not in drop and c not in fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, column, limit):
            yield pa.RecordBatch.from_arrays([*(slab.column(c) for c in names), *compute(slab)], names=[*names, *fields.names])

    return df.mapInArrow(tidy(run), T.StructType([*(df.schema[c] for c in names), *fields]))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _prime_powers(base: int, size: int) -> np.ndarray:
    """Powers of base modulo the prime, by doubling."""
    p = np.ones(1, np.uint64)
    while len(p) < size:
        p = np.concatenate((p, p * np.uint64(pow(base, len(p), _PRIME)) % np.uint64(_PRIME)))
    return p[:size].astype(np.uint32)


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the bases and of their inverses, modulo 2**64 and modulo the prime."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLAB_BYTES * 2)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        _powers.extend(_prime_powers(b, size) for b in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)))
    return _powers


def word_hashes(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of all texts, and offsets: words of text i are at [offsets[i], offsets[i + 1]).

    A word is a run of bytes other than space and \\t to \\r. Case is kept. Its hash mixes a polynomial of its bytes modulo 2**64 with one
    modulo a prime, which tells words apart whose pattern makes the first one equal. For each length in prefixes an array follows with
    hashes of the words' first bytes, no more than that many.
    """
    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[blob]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        turns = np.concatenate(([0], turns))
    first, last = turns.reshape(-1, 2).T
    power, inverse, prime_power, prime_inverse = _tables(len(blob) + 1)
    prime = np.uint64(_PRIME)
    value = blob.astype(np.uint64) + np.uint64(1)
    running, modular = np.zeros(len(blob) + 1, np.uint64), np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(value * power[: len(blob)], out=running[1:])
    np.cumsum(value * prime_power[: len(blob)] % prime, out=modular[1:])

    def hashed(end: np.ndarray) -> np.ndarray:
        second = (modular[end] - modular[first]) % prime * prime_inverse[first] % prime
        return mix64(((running[end] - running[first]) * inverse[first]) ^ mix64(second + np.uint64(1)))

    offsets = np.concatenate(([0], np.searchsorted(first, ends)))
    return hashed(last), offsets, *(hashed(np.minimum(first + n, last)) ^ np.uint64(n) for n in prefixes)


_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def plain_words(text: str | None) -> bytes:
    """The text in lower case with ASCII other than letters and digits as spaces, for word_hashes."""
    return (text or "").lower().encode().translate(_LETTERS)
