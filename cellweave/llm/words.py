"""Word and shingle hashes of whole batches by numpy. Words are runs of bytes other than 20 and 09 to 0D (hex)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def letters(fold: bool) -> np.ndarray:
    """A random number for each byte, 0 for white space; with fold A-Z count as a-z."""
    t = mixed(np.arange(1, 257, dtype=np.uint64) * GOLD)
    if fold:
        t[65:91] = t[97:123]
    t[[32, *range(9, 14)]] = 0
    return t


POWER = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def powers(bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << bits, POWER, np.uint64))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each ends; null texts are empty. No copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at[1:] - at[0]


def word_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where in raw each word begins; a word ends with its text."""
    inside = letters(False)[raw] != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = np.r_[0, ends[:-1]]
    firsts = firsts[firsts < len(raw)]
    start[firsts] = inside[firsts]
    return np.flatnonzero(start)


def word_hashes(raw: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and the number of words in each text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    table = letters(fold)
    starts = word_starts(raw, ends)
    per_text = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    at = np.arange(len(raw), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    at[: starts[0]] = 0
    power = powers(max(10, int(at.max()).bit_length()))
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(table[raw] * power[at], starts)), per_text


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; runs at the end that are cut short are left out."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= POWER
            out += words[k : k + n]
    return mixed(out)


def widened(hashes: np.ndarray, size: int, to: int) -> np.ndarray:
    """From the hashes of runs of size words those of runs of to (twice size at most): each from the two that it starts and ends with."""
    n = max(0, len(hashes) - (to - size))
    with np.errstate(over="ignore"):
        return mixed(hashes[:n] * GOLD + hashes[to - size : to - size + n])
