"""Vectorised text primitives: Arrow string columns as flat bytes, word spans, word and shingle hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  UTF-8 never uses those values inside a
multi-byte character, so byte-wise splitting equals character-wise splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes (one longer text makes a slice of its own).
SLICE_BYTES = 1 << 20

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(salt) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 7)
_BASE = _U(0x9E3779B97F4A7C13)  # 3 mod 4: differences of powers lose few bits
_INVERSE = _U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_powers = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = pa.large_binary(), np.int64
    else:
        kind, width = pa.binary(), np.int32
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows with about ``limit`` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        data, offs = flat(batch.column(batch.schema.get_field_index(column)))
        for at, to in cuts(offs, limit):
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]


def cuts(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) with about ``limit`` bytes each."""
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans of all words; ``first[i]:first[i+1]`` are the words of text ``i``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    ink = ~SPACE[data]
    start, stop = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    full = offs[:-1] < offs[1:]
    head, tail = offs[:-1][full], offs[1:][full] - 1
    start[head], stop[tail] = ink[head], ink[tail]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the slice."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[data] * _power("up", n), out=sums[1:], dtype=_U)
    return mix((sums[end] - sums[start]) * _power("down", n + 1)[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``k``-word shingles of each text, sorted within the text: (hashes, first).

    A text of 1 to k-1 words has one shingle, its whole word sequence; a text without words has none.
    """
    c = seeds(k + 1, 11)
    count = np.diff(first)
    n = len(h)
    made = np.zeros(n, dtype=_U)
    for j in range(min(k, n)):
        made[: n - j] += h[j:] * c[j]
    text = np.repeat(np.arange(len(count)), count)
    keep = np.arange(n) + k <= first[1:][text]
    short = np.flatnonzero((count > 0) & (count < k))
    for size in range(1, k):
        own = short[count[short] == size]
        if len(own):
            at = first[own]
            made[at] = sum((h[at + j] * c[j] for j in range(size)), np.zeros(len(own), _U)) + c[k] * np.full(1, size, _U)
            keep[at] = True
    made, text = mix(made[keep]), text[keep]
    order = np.lexsort((made, text))
    made, text = made[order], text[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (text[1:] != text[:-1])
    made, text = made[new], text[new]
    return made, np.searchsorted(text, np.arange(len(count) + 1))
