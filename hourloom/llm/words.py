"""Words of Arrow string columns as numpy arrays, straight from their UTF-8 buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. All of these are single bytes in UTF-8, so bytes and code points give the same words.
Texts are handled in slices of a few hundred kilobytes, which bounds the temporary arrays whatever
the batch; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive texts; null texts are empty. offsets has one entry more than texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


@dataclass
class Words:
    """Words of several texts: byte ranges, and for each text the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]  # words end where their text ends
    begins[edges] = inside[edges]
    later = edges[edges > 0] - 1
    stops[later] = inside[later]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, BASE, np.uint64)
        down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hash_words(raw: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word from running polynomial sums, then mixed."""
    size = SLICE_BYTES
    while size < len(raw):
        size *= 2
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        length = (words.ends - words.starts).astype(np.uint64)
        return mix((sums[words.ends] - sums[words.starts]) * down[words.starts] + length * np.uint64(BASE))


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the width-word shingles of each text, repeats included.

    A text of fewer words has one shingle made of all its words, a text without words has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = offsets[:-1][owner] + np.arange(out[-1]) - out[:-1][owner]
    length = np.minimum(counts, width)[owner]
    total = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
        for k in range(width):
            total = total * np.uint64(0xD1342543DE82EF95) + np.where(length > k, padded[first + k], np.uint64(0))
        return mix(total), out
