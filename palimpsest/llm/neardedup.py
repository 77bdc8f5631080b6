"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact sets, star components.

Documents with equal shingle sets are one node from the start, so a group of copies costs one row in every later step.
Bands only propose pairs; a pair is linked after its signatures agree well enough and its full sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import rolling, stars
from palimpsest.llm.shared import written

SHINGLE = 4
BANDS = 32
ROWS = 4
PERCENT = 80
SPREAD = 5  # a pair is dropped by its signatures only this many standard deviations below the threshold


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` universal hash functions, fixed."""
    seeds = rolling.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(docs: DataFrame, size: int = SHINGLE, hashes: int = BANDS * ROWS) -> DataFrame:
    """(doc_id, n_shingles, low, high, signature): two sums that identify the set, and the high halves of its minima."""
    a, b = _factors(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, low, high, minima = [], [], [], []
            for found, of, n in rolling.text_shingles(batch.column("text"), size):
                order = np.lexsort((found, of)) if len(found) else np.empty(0, np.int64)
                found, of = found[order], of[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                found, of = found[new], of[new]
                count = np.bincount(of, minlength=n)
                some = np.flatnonzero(count)
                starts = np.searchsorted(of, some)
                sums = np.zeros((2, n), np.uint64)
                rows = np.zeros((n, hashes), np.uint32)
                if len(some):
                    for k in range(2):
                        sums[k, some] = np.add.reduceat(rolling.mix(found + np.uint64(0xA0761D6478BD642F * (k + 1) & rolling.MASK)), starts)
                    work = np.empty_like(found)
                    for k in range(hashes):
                        np.multiply(found, a[k], out=work)
                        work += b[k]
                        rows[some, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
                counts.append(count)
                low.append(sums[0])
                high.append(sums[1])
                minima += [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    *[pa.array(np.concatenate(x).view(np.int64) if x else [], pa.int64()) for x in (low, high)],
                    pa.array(minima, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "low", "high", "signature"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, signature binary")


def _bands(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node): a bucket for every band of a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for k in range(rows):
                key = rolling.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            node = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["bucket", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "bucket long, node long")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column of either side; ``table`` has one row for a node."""
    left, right = (table.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least this share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"signature_{s}").to_pylist()), np.uint32).reshape(batch.num_rows, -1) for s in "ab")
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


COLUMNS = 8192


def similar_sets(left: list[bytes], right: list[bytes] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all similar pairs of two lists of sets, or within one: intersections as a product of 0/1 matrices."""
    whole = right is None
    sets = [np.frombuffer(s, np.uint64) for s in (left if whole else left + right)]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1  # the others add nothing to any intersection
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = len(left)
    both = np.zeros((n, len(sets) - (0 if whole else n)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part[:n] @ (part if whole else part[n:]).T
    union = sizes[:n, None] + (sizes if whole else sizes[n:])[None, :] - both
    found = 100 * both >= percent * union
    return np.nonzero(np.triu(found, 1) if whole else found)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, set): the sorted distinct shingles of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in rolling.shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable through links, its own included), kept.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; a null
    text or one without words has none and is linked with nothing. Rows that share an id are one node of the graph. A null
    id is linked with nothing: its component is null and it is kept. Every row gives a row; no rows give none. ``docs`` needs
    doc_id and text; other columns are ignored. With 32 bands of 4 rows a pair at the threshold is proposed with
    probability 1 - 5e-8.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(docs, size, bands * rows), "signatures")
    groups = signed.where("n_shingles > 0 and doc_id is not null").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("node"))
    groups = written(groups, "equal-sets")
    mine = signed.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "low", "high", "n_shingles", "signature")
    nodes = written(mine.drop("n_shingles").join(groups.drop("n_shingles"), ["node", "low", "high"]).dropDuplicates(["node", "low", "high"]).select("node", "low", "signature"), "nodes")
    keyed = _bands(nodes, bands, rows)
    members = stars.shared(keyed, keyed)

    # an id may carry several texts: their sets and signatures are several rows of the node, and any of them may link it
    proposed = members.select("node").distinct()
    texts = docs.withColumnRenamed("doc_id", "node").join(proposed, "node")
    sets = written(_sets(texts, size), "sets")
    least = percent / 100 - SPREAD * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    def verify(pairs: DataFrame) -> DataFrame:
        near = _agreeing(_with_both(pairs, nodes, "signature"), least).distinct()
        return _similar(_with_both(written(near, "near"), sets, "set"), percent).distinct()

    roots, _ = stars.linked(members, verify, sets.withColumnRenamed("set", "payload"), lambda x, y: similar_sets(x, y, percent))
    out = signed.join(groups, ["low", "high", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = out.join(roots, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component; of repeated rows all stay or go."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
