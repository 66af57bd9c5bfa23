"""Whole texts as byte arrays: word spans, word hashes and hash mixing, vectorised over Arrow buffers.

Words are runs of digits, a-z and non-ASCII characters after A-Z is lower-cased.  Every byte of a
non-ASCII UTF-8 character is at least 0x80, so the scan works on bytes.  Null texts have no words.
"""

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 2 << 20


class Words(NamedTuple):
    """One entry per word: its text's number, byte span and 64-bit hash; ``data`` is lower-cased and padded by eight bytes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray


def mix(x):
    """A bijective 64-bit finaliser; works on any uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def passes(offsets, most=PASS_BYTES):
    """Row ranges (lo, hi) of about ``most`` bytes each, one row at least."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


_HELD = {}


def held(key, make):
    """A large helper object that a Python worker keeps for its later batches; it makes room when other work begins."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def make_room():
    """Drop what earlier work of this Python worker has kept, and give unused memory back to the machine."""
    _HELD.clear()
    give_back()


def give_back():
    """Return memory that is free, but still held by this process, to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def column_passes(column, most=PASS_BYTES):
    """(lo, hi, bytes, offsets) of each pass over an Arrow string column; only one pass is ever copied."""
    make_room()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in passes(np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)]), most):
        yield lo, hi, *text_bytes(column.slice(lo, hi - lo))


def scan(data, offsets):
    """Find and hash the words of all texts of a pass."""
    n = len(data)
    low = np.zeros(n + 8, np.uint8)
    np.take(LOWER, data, out=low[:n])
    inside = IS_WORD[low[:n]]
    firsts = offsets[:-1][offsets[:-1] < n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = firsts[firsts > 0] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, hash_spans(low, start, end), low)


def eight_bytes(data):
    """The eight bytes from each position on, as one little-endian number; ``data`` is padded by eight bytes."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def keep_bytes(chunk, count):
    """The first ``count`` (up to eight) bytes of each chunk, the others zero."""
    bits = (np.minimum(count, 8) * 8).astype(np.uint64)
    return np.where(bits >= 64, chunk, chunk & ((np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1)))


def hash_spans(data, start, end, seed=0x9E3779B97F4A7C15):
    """64-bit hashes of byte spans, eight bytes at a time."""
    view = eight_bytes(data)
    left = end - start
    out = mix(keep_bytes(view[start], left) + np.uint64(seed)) + left.astype(np.uint64)
    alive, at = np.flatnonzero(left > 8), 8
    while len(alive):
        out[alive] = mix(out[alive] * np.uint64(0x100000001B3) + keep_bytes(view[start[alive] + at], left[alive] - at))
        at += 8
        alive = alive[left[alive] > at]
    return mix(out)


def runs(sorted_values):
    """Start positions of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
