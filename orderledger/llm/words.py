"""Words of whole texts as arrays of 64-bit hashes, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


class _Hashes(dict):
    """Word -> hash, remembered by the worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def forget_words() -> None:
    """Empty the remembered hashes, and give Arrow's unused memory back: a worker serves many
    stages, and a task that is over leaves it nothing."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> _SHIFT)) * _P2
    return values ^ (values >> _SHIFT)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and that of its last element."""
    return mix(left * _P1 + right)


def split_words(text: str | None) -> list[bytes]:
    """The runs of characters other than U+0020 and U+0009 to U+000D, in UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


class WordBatch(NamedTuple):
    """Word hashes of several documents one after another; `row` says whose they are."""

    hashes: np.ndarray
    row: np.ndarray
    counts: np.ndarray


def word_batch(words: list[list[bytes]]) -> WordBatch:
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = map(_hashes.__getitem__, chain.from_iterable(words))
    hashes = np.fromiter(flat, np.uint64, int(counts.sum()))
    return WordBatch(hashes, np.repeat(np.arange(len(words)), counts), counts)


def windows(batch: WordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `size` words that lies in one document, and its first position."""
    hashes, row = batch.hashes, batch.row
    n = max(0, len(hashes) - size + 1)
    value = mix(hashes[:n])
    for k in range(1, size):
        value = join_hash(value, hashes[k : n + k])
    inside = row[:n] == row[size - 1 : n + size - 1]
    return value[inside], np.flatnonzero(inside)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about `most` bytes of text each, one row at the least.

    What is derived from a text is many times its size, so a worker holds a part at a time.
    """
    for batch in batches:
        sizes = np.array([v.as_buffer().size if v.is_valid else 0 for v in batch.column(column)])
        part = (np.cumsum(sizes) - sizes) // most if len(sizes) else sizes
        bounds = np.flatnonzero(np.diff(part, prepend=-1))
        for start, end in zip(bounds, [*bounds[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
