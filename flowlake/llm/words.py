"""Hashes of all words of an Arrow column in a few numpy passes.

A word's 64-bit hash is a polynomial in random byte values, so the words of a slice of texts are
hashed by one multiplication per byte and one segmented sum, without a Python object per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from flowlake.llm.common import utf8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at a time; bounds the tables of powers and what is held beside them, about 40 bytes for each.
CHUNK = 1 << 18


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=8)
def byte_values(word_bytes: bytes) -> np.ndarray:
    """A random odd value for each byte of ``word_bytes`` (256 flags), 0 for the others."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.where(np.frombuffer(word_bytes, np.uint8) > 0, values, np.uint64(0))


#: Words are runs of anything but white space.
UNSPACED = bytes(int(not (c == 32 or 9 <= c <= 13)) for c in range(256))
#: Words are runs of ASCII letters and digits and of all other letters.
LETTERS = bytes(int(chr(c).isalnum() if c < 128 else 1) for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(column: pa.StringArray, word_bytes: bytes = UNSPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(raw, at, first)``: all bytes, where each word begins, and the number of each text's first word."""
    raw, offsets = utf8(column)
    if not len(raw):
        return raw, np.empty(0, np.int64), np.zeros(len(column) + 1, np.int64)
    inside = np.frombuffer(word_bytes, np.uint8)[raw].view(bool)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = offsets[:-1][offsets[:-1] < len(raw)]
    starts[ends] = inside[ends]
    at = np.flatnonzero(starts)
    return raw, at, np.searchsorted(at, offsets)


def word_hashes(column: pa.StringArray, word_bytes: bytes = UNSPACED) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: hashes of the words of all texts, and the number of each text's first word."""
    raw, at, first = word_starts(column, word_bytes)
    values = byte_values(word_bytes)
    hashes = np.empty(len(at), np.uint64)
    done = 0
    while done < len(at):
        low = at[done]
        stop = int(np.searchsorted(at, low + CHUNK, side="left"))
        high = at[stop] if stop < len(at) else len(raw)
        n = int(high - low)
        size = max(CHUNK, 1 << (n - 1).bit_length())
        terms = values[raw[low:high]] * _powers(int(_BASE), size)[:n]
        sums = np.add.reduceat(terms, at[done:stop] - low)
        hashes[done:stop] = sums * _powers(int(_INVERSE), size)[at[done:stop] - low]
        done = stop
    return mix(hashes), first


def prefix_hashes(column: pa.StringArray, lengths: range, word_bytes: bytes):
    """For each length in bytes ``(numbers of the longer words, hashes of their beginnings)``, and last ``first``."""
    raw, at, first = word_starts(column, word_bytes)
    values = byte_values(word_bytes)
    text_end = utf8(column)[1][1:]
    end = np.repeat(text_end, np.diff(first))
    alive, total, factor = np.arange(len(at)), np.zeros(len(at), np.uint64), 1
    for k in range(lengths.stop):
        here = at[alive] + k
        value = values[raw[np.minimum(here, len(raw) - 1)]] if len(raw) else np.empty(0, np.uint64)
        stays = (value != 0) & (here < end[alive])
        if k in lengths:
            yield alive[stays], mix(total[stays] + np.uint64(k))
        alive, total = alive[stays], total[stays] + value[stays] * np.uint64(factor)
        factor = factor * int(_BASE) % (1 << 64)
    yield None, first


def shingle_hashes(column: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)`` of all runs of ``size`` words; a text with fewer words, but one, is one run."""
    words, first = word_hashes(column)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - total[:-1], n) + np.arange(total[-1])
    last = np.repeat(first[1:], n)
    out = np.zeros(len(at), np.uint64)
    factor = 1
    for k in range(size):
        here = at + k
        part = words[np.minimum(here, len(words) - 1)] * np.uint64(factor) if len(words) else out
        out += np.where(here < last, part, np.uint64(0))
        factor = factor * int(_BASE) % (1 << 64)
    return mix(out), total
