"""Word and shingle hashes of Arrow text batches, in numpy over the bytes.

A word's hash is a polynomial over its bytes, taken from prefix sums of the whole piece (arithmetic modulo 2**64) and then
mixed; so its cost does not depend on how the bytes fall into words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
PIECE_BYTES = 1 << 20

#: ASCII white space, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept while the worker lives, as long as the longest piece."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, PIECE_BYTES), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES, most: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of at most ``most`` whole texts, of about ``limit`` bytes: first row, bytes, offsets of the texts in them. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, at + most)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of bytes that ``apart`` does not mark."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's bounds end a run
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each span of the bytes behind ``sums``; equal bytes have equal hashes wherever they stand."""
    shift = _power(pow(BASE, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, rows: np.ndarray, size: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their text; a text of fewer words is one run, one of none has none."""
    factor = [np.uint64(mix(np.array([n + 1], np.uint64))[0] | np.uint64(1)) for n in range(size)]

    def run(at: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(at), n, np.uint64)
        for j in range(n):
            total = total + words[at + j] * factor[j]
        return mix(total)

    bounds = np.searchsorted(rows, np.arange(texts + 1))
    count = np.diff(bounds)
    full = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :]) if len(rows) >= size else np.empty(0, np.int64)
    found, of = [run(full, size)], [rows[full]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        found.append(run(bounds[:-1][short], n))
        of.append(short)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], of[order]


def text_shingles(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For runs of texts the hashes of all shingles, their text in the run, and the number of texts."""
    for _, data, offsets in pieces(texts):
        data = LOWER[data]
        starts, ends, rows = spans(data, offsets)
        yield *shingles(hashes(prefix(data), starts, ends), rows, size, len(offsets) - 1), len(offsets) - 1


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, in order."""
    for found, of, n in text_shingles(texts, size):
        bounds = np.searchsorted(of, np.arange(n + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(found[a:b])
