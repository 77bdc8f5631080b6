"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

The shingles of a text are hashed once; the high bits choose one of ``bins``, the smallest hash of a bin is its value. An
empty bin copies a filled one, found by probing with a fixed hash of (bin, attempt), so that any two texts probe alike. The
lowest ``bits`` of every value are kept. Two unrelated values agree in them with probability 2**-bits, which the
likeness takes out again.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.rolling import mix, text_shingles

SHINGLE = 5
BINS = 512
BITS = 4
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


ATTEMPTS = 8


@functools.cache
def _probes(bins: int, turn: int) -> np.ndarray:
    """The bins that each bin tries, ATTEMPTS at a turn."""
    attempt = np.arange(turn * ATTEMPTS, (turn + 1) * ATTEMPTS, dtype=np.uint64)
    return (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt[:, None]) % np.uint64(bins)).astype(np.int64)


def values(shingles: np.ndarray, rows: np.ndarray, texts: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The densified bin minima of each text (texts x bins), and which texts have any shingle."""
    x = mix(shingles)
    bin_of = (x >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64) % bins
    out = np.full(texts * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(texts * bins, bool)
    np.minimum.at(out, rows * bins + bin_of, x)
    filled[rows * bins + bin_of] = True
    out, filled = out.reshape(texts, bins), filled.reshape(texts, bins)
    some = filled.any(axis=1)
    row, empty = np.nonzero(~filled & some[:, None])
    turn = 0
    while len(row):
        for probes in _probes(bins, turn):
            probe = probes[empty]
            hit = filled[row, probe]
            out[row[hit], empty[hit]] = out[row[hit], probe[hit]]
            row, empty = row[~hit], empty[~hit]
        turn += 1
    return out, some


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest ``bits`` of each value, packed: a row of bytes for each text.

    Mixed with the bin, so that copies of one value in several bins of two small texts do not agree all at once by chance.
    """
    low = mix(values + np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) & np.uint64((1 << bits) - 1)
    rows = (low.astype(np.uint8)[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(rows.reshape(len(values), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row: the share of equal values, less what chance gives, 0 to 1."""
    x, y = (np.unpackbits(p, axis=1).reshape(len(p), -1, bits) for p in (a, b))
    chance = 2.0**-bits
    return np.clip(((x == y).all(axis=2).mean(axis=1) - chance) / (1 - chance), 0, 1)


def fingerprints(texts: list[str], size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints of texts, and which texts have one."""
    rows, some = [np.empty((0, bins * bits // 8), np.uint8)], [np.empty(0, bool)]
    for shingles, of, n in text_shingles(pa.array(texts, pa.large_string()), size):
        found, any_ = values(shingles, of, n, bins)
        rows.append(packed(found, bits))
        some.append(any_)
    return np.concatenate(rows), np.concatenate(some)


def as_text(rows: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal; that of a text without words is empty."""
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some)]


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Likeness of two runs of fingerprints; one without words is like another (1) and unlike all else (0)."""
    return np.where(a[1] & b[1], likeness(a[0], b[0], bits), (a[1] == b[1]).astype(float))


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _cell(bounds: list[int], doc_id: Column) -> Column:
    """How many bounds are not above the id, found in two steps of about the square root of their number; null is last."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    table = F.array(*[F.array(*[F.lit(b) for b in run]) for run in runs])
    run = F.array_size(F.filter(F.array(*[F.lit(r[0]) for r in runs]), lambda b: b <= doc_id))
    within = F.array_size(F.filter(F.get(table, run - 1), lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), len(bounds)).when(run == 0, 0).otherwise((run - 1) * step + within)


def in_order(docs: DataFrame) -> DataFrame:
    """(cell, tail, doc_id, text): documents dealt into cells of neighbouring ids, and at the end of each a copy (tail) of the
    row that follows: the first of the next cell, of the first after the last.

    The bounds come from a quantile sketch of the ids: any bounds are right, these make cells even. Only bounds and first
    ids, at most four times the number of shuffle partitions, pass the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    cells = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 20 * cells).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    body = docs.withColumn("cell", _cell(bounds, F.col("doc_id")).cast("int"))
    firsts = sorted((r["cell"], r["first"]) for r in body.groupBy("cell").agg(F.min("doc_id").alias("first")).collect() if r["first"] is not None)
    follows = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
    tails = (
        docs.join(F.broadcast(spark.createDataFrame(follows, "cell int, doc_id long")), "doc_id")
        .groupBy("cell")
        .agg(F.min(F.struct("doc_id", "text")).alias("r"))
        .select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), "cell")
    )
    both = body.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    return both.repartition(cells // 4, "cell").sortWithinPartitions("cell", "tail", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())


def fingerprint_edits(docs: DataFrame, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness of its own to the edited and the next one's.

    The edited text has its last quarter replaced by the start of the next document's, in the order of ids; after the last
    comes the first. Rows that share an id are ordered by text, null first; rows with a null id come last. ``docs`` needs
    doc_id and text; other columns are ignored. A null text is an empty one; an empty fingerprint is like another empty one
    (1) and unlike all else (0). A text shorter than a shingle is one shingle. Every row gives a row; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """All rows but the last: (doc_id, text), each followed by the next."""
            texts = [r[1] for r in rows]
            own = fingerprints(texts, size, bins, bits)
            first, after = [(x[:-1]) for x in own], [x[1:] for x in own]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            other = fingerprints(changed, size, bins, bits)
            columns = [
                [r[0] for r in rows[:-1]],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                as_text(*first),
                as_text(*other),
                alike(first, other, bits),
                alike(first, after, bits),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(columns, SCHEMA.split(", "))], names=names)

        cell, first, ended, rows = None, None, False, []

        def close() -> list[tuple]:
            """A cell without a tail is the only one: its first row follows its last."""
            return rows if ended or not rows else [*rows, first]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for c, tail, doc, text in zip(*(part.column(n).to_pylist() for n in ("cell", "tail", "doc_id", "text"))):
                    if c != cell:
                        if len(left := close()) > 1:
                            yield done(left)
                        cell, first, ended, rows = c, (doc, text or ""), False, []
                    rows.append((doc, text or ""))
                    ended = tail
                    if len(rows) > 256 or sum(len(r[1]) for r in rows[-1:]) > 1 << 20:
                        if len(rows) > 1:
                            yield done(rows)
                            rows = rows[-1:]
        if len(left := close()) > 1:
            yield done(left)

    return in_order(docs).mapInArrow(run, SCHEMA)
