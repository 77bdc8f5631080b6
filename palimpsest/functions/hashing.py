"""Content hashes, similarity hashes and deterministic ids."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import _c

ID_LENGTH = 32


def content_sha256(col) -> Column:
    return F.sha2(_c(col), 256)


def message_hash(content, calls, call_id) -> Column:
    """SHA-256 over content, tool calls and tool id, the identity of a stored message."""
    parts = [_c(content), F.coalesce(_c(calls), F.lit("")), F.coalesce(_c(call_id), F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


class _BitTable:
    """Bit votes (+1/-1) of the bigrams of a batch, looked up by code point pair."""

    def __init__(self, digest):
        self.digest = digest
        self.codes = np.empty(0, dtype=np.uint64)
        self.votes = np.empty((0, 64), dtype=np.float64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = codes[~known]
            pairs = [chr(int(c) >> 32) + chr(int(c) & 0xFFFFFFFF) for c in new]
            raw = np.frombuffer(b"".join(self.digest(p.encode("utf-8", "surrogatepass")) for p in pairs), dtype=np.uint8).reshape(-1, 8)
            votes = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float64) * 2 - 1
            order = np.argsort(np.concatenate([self.codes, new]), kind="stable")
            self.codes = np.concatenate([self.codes, new])[order]
            self.votes = np.concatenate([self.votes, votes])[order]
            at = np.searchsorted(self.codes, codes)
        return self.votes[at]


def _simhash_batch(texts: pd.Series, digest) -> pd.Series:
    """64-bit similarity hashes of a batch: each distinct bigram of a text votes with its count."""
    table = _BitTable(digest)  # as large as the distinct bigrams of the batch
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts.fillna("").to_numpy()):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if len(points) > 1:
            codes, counts = np.unique((points[:-1] << np.uint64(32)) | points[1:], return_counts=True)
            votes = counts.astype(np.float64) @ table.rows(codes)
            out[i] = np.bitwise_or.reduce(np.where(votes > 0, weights, np.uint64(0)))
    return pd.Series(out.view(np.int64))


def blake64(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def md5_64(data: bytes) -> bytes:
    return hashlib.md5(data).digest()[:8]


@F.pandas_udf(T.LongType())
def _simhash_blake2b(texts: pd.Series) -> pd.Series:
    return _simhash_batch(texts, blake64)


@F.pandas_udf(T.LongType())
def _simhash_md5(texts: pd.Series) -> pd.Series:
    return _simhash_batch(texts, md5_64)


def simhash64(col, hash: str = "blake2b") -> Column:
    """64-bit similarity hash over all character bigrams, as a signed long."""
    return {"blake2b": _simhash_blake2b, "md5": _simhash_md5}[hash](_c(col))


def hex64(col) -> Column:
    return F.lpad(F.lower(F.hex(_c(col))), 16, "0")


def hamming64(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def det_id(prefix: str, *parts) -> Column:
    """Deterministic row id: prefix and 26 hex digits of a hash over the identifying parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[_c(p) if isinstance(p, str) else p for p in parts])), 1, 26))


def import_id(prefix: str, external) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(_c(external)), 1, 26)))


def normalize_id(col, prefix: str, length: int = ID_LENGTH) -> Column:
    """Exactly ``length`` characters: the prefixed id cut and sealed with 4 hash digits, or padded with a hash."""
    c = F.when(F.startswith(_c(col), F.lit(prefix)), _c(col)).otherwise(F.concat(F.lit(prefix), _c(col)))
    cut = F.concat(F.substring(c, 1, length - 4), F.substring(F.md5(c), 1, 4))
    pad = F.concat(c, F.substring(F.md5(F.concat(c, F.lit("_pad"))), F.lit(1), F.lit(length) - F.length(c)))
    return F.when(F.length(c) >= length, cut).otherwise(pad)


def alias_id(node_id, alias, length: int = ID_LENGTH) -> Column:
    """Alias id from the node's id and a hash of the alias, fitted to ``length`` characters."""
    tag = F.substring(F.md5(_c(alias)), 1, 8)
    whole = F.concat(F.lit("a_"), F.regexp_replace(_c(node_id), "^n_", ""), F.lit("_"), tag)
    long = F.concat(F.substring(whole, 1, length - 8), tag)
    return F.when(F.length(whole) > length, long).otherwise(normalize_id(whole, "a_", length))
