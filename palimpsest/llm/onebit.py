"""Rotated one-bit codes of integer vectors, with alignments, and intervals that surely hold an inner product.

A vector is rotated and known by the signs of its coordinates: the unit vector of those signs, times the stored alignment
(the vector's product with it), is the part that the code explains. What is left is rotated and coded again, a few levels
deep. The query's coordinates are rounded to a few bits, so its product with a code is a sum of popcounts over bit planes.
The rest of the vector is orthogonal to the last code, and by Cauchy-Schwarz its product with the query is at most the
product of the lengths of two residuals; rounding adds at most the length of the rounding error times the alignment.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from palimpsest.llm import rolling

LEVELS = 4
PLANES = 6
TURNS = 3  # sign flips and butterflies of a rotation


def padded(dim: int) -> int:
    """The power of two, 64 at least, to which vectors are filled up with zeros."""
    return max(64, 1 << max(0, dim - 1).bit_length())


@lru_cache(maxsize=8)
def _signs(width: int, level: int) -> np.ndarray:
    """The fixed sign flips of a rotation: the same on every machine."""
    seeds = rolling.mix(np.arange(1, TURNS * width + 1, dtype=np.uint64) + np.uint64((level + 1) << 32))
    return np.where(seeds >> np.uint64(63), 1.0, -1.0).reshape(TURNS, width)


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """Rows turned by sign flips and Walsh-Hadamard butterflies."""
    n, width = x.shape
    for signs in _signs(width, level):
        x = x * signs
        step = 1
        while step < width:
            pair = x.reshape(n, width // (2 * step), 2, step)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
        x = x / np.sqrt(width)
    return x


class Codes(NamedTuple):
    """Signs as 64-bit words (rows x levels x words), alignments (rows x levels), residual lengths and lengths (rows)."""

    words: np.ndarray
    aligned: np.ndarray
    rest: np.ndarray
    length: np.ndarray

    def take(self, at: np.ndarray) -> Codes:
        return Codes(*(x[at] for x in self))


def _filled(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), padded(x.shape[1])))
    out[:, : x.shape[1]] = x
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view("<u8")


def encode(x: np.ndarray, levels: int = LEVELS) -> Codes:
    """Codes of the rows of an integer matrix."""
    rest = _filled(x)
    length = np.sqrt((rest * rest).sum(axis=1))
    words, aligned = [], []
    for level in range(levels):
        rest = rotate(rest, level)
        bits = rest >= 0
        a = np.abs(rest).sum(axis=1) / np.sqrt(rest.shape[1])
        rest = rest - np.where(bits, 1.0, -1.0) * (a / np.sqrt(rest.shape[1]))[:, None]
        words.append(_packed(bits))
        aligned.append(a)
    return Codes(np.stack(words, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1)), length)


class Queries(NamedTuple):
    """Of each query and level: bit planes (queries x levels x planes x words), step, lowest value and sum of the rounded
    coordinates, and length of the rounding error; and the query's length."""

    planes: np.ndarray
    step: np.ndarray
    lowest: np.ndarray
    total: np.ndarray
    error: np.ndarray
    length: np.ndarray

    def take(self, at) -> Queries:
        return Queries(*(x[at] for x in self))


def ask(x: np.ndarray, levels: int = LEVELS, planes: int = PLANES) -> Queries:
    """Queries of the rows of an integer matrix."""
    turned = _filled(x)
    length = np.sqrt((turned * turned).sum(axis=1))
    out = []
    for level in range(levels):
        turned = rotate(turned, level)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << planes) - 1), np.finfo(float).tiny)
        whole = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << planes) - 1).astype(np.int64)
        near = low[:, None] + step[:, None] * whole
        bits = np.stack([_packed((whole >> p & 1).astype(bool)) for p in range(planes)], axis=1)
        out.append((bits, step, low, near.sum(axis=1), np.sqrt(((turned - near) ** 2).sum(axis=1))))
    return Queries(*(np.stack(parts, axis=1) for parts in zip(*out)), length)


def intervals(q: Queries, x: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and half-widths (queries x rows): the true products lie within."""
    width = x.words.shape[2] * 64
    estimate = np.zeros((len(q.length), len(x.length)))
    slack = np.zeros_like(estimate)
    for level in range(x.words.shape[1]):
        shared = np.zeros(estimate.shape, np.int32)
        for p in range(q.planes.shape[2]):
            for w in range(x.words.shape[2]):
                shared += np.bitwise_count(q.planes[:, level, p, w, None] & x.words[None, :, level, w]).astype(np.int32) << p
        ones = np.bitwise_count(x.words[:, level]).sum(axis=1)
        product = (2 * (q.lowest[:, level, None] * ones + q.step[:, level, None] * shared) - q.total[:, level, None]) / np.sqrt(width)
        estimate += x.aligned[None, :, level] * product
        slack += x.aligned[None, :, level] * q.error[:, level, None]
    along = np.maximum(np.abs(product) - q.error[:, -1, None], 0)  # of the last level
    across = np.sqrt(np.maximum(q.length[:, None] ** 2 - along**2, 0))
    rounding = 1e-9 * q.length[:, None] * x.length[None, :] + 1e-6
    return estimate, across * x.rest[None, :] + slack + rounding
