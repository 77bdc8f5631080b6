"""Hard-negative mining: one-bit codes filter the rows that an anchor meets, the survivors are scored in integers.

Rows and anchors are dealt into cells of bounded size; every cell of anchors meets every cell of rows in a task of its own,
so neither a label nor a group of equal vectors comes together anywhere. A cell gives an anchor's best rows of the cell
only, and the best of those are found by their rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import onebit
from palimpsest.llm.shared import written

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
CELL_ROWS = 16384
CELL_ANCHORS = 8192
BLOCK = 64  # anchors compared at once
PROBE = 4  # so many times the wanted rows are scored first
NONE = np.int64(-(1 << 62))  # no bound

ROW = "vec_id long, label long, dim int, vector binary, words binary, aligned binary, rest double, length double"
HIT = "anchor_id long, anchor_key long, other_id long, score long"


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<i8").reshape(-1, dim)


def coded(vectors: DataFrame, levels: int) -> DataFrame:
    """The rows with their vectors as bytes, and their codes."""

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(part.num_rows, dim)
                for at in range(0, part.num_rows, 2048):
                    c = onebit.encode(x[at : at + 2048], levels)
                    columns = [part.column(n).slice(at, 2048) for n in ("vec_id", "label", "dim")]
                    columns += [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x[at : at + 2048], c.words, c.aligned)]
                    columns += [pa.array(c.rest), pa.array(c.length)]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROW.split(", ")])

    return vectors.mapInArrow(run, ROW)


def _codes(table: pa.Table, levels: int) -> onebit.Codes:
    n = table.num_rows
    words = np.frombuffer(b"".join(table["words"].to_pylist()), "<u8").reshape(n, levels, -1)
    aligned = np.frombuffer(b"".join(table["aligned"].to_pylist()), "<f8").reshape(n, levels)
    return onebit.Codes(words, aligned, table["rest"].to_numpy(), table["length"].to_numpy())


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (i, j); beyond 63 bits in Python's integers, and a score that no long holds is an error."""
    most = int(np.abs(q.astype(float)).max(initial=0)) * int(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 62:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            out[at : at + (1 << 16)] = np.einsum("nd,nd->n", q[i[at : at + (1 << 16)]], x[j[at : at + (1 << 16)]])
        return out
    return np.array([sum(a * b for a, b in zip(q[m].tolist(), x[n].tolist())) for m, n in zip(i.tolist(), j.tolist())], object).astype(np.int64)


def _best(anchor: np.ndarray, score: np.ndarray, vec_id: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each anchor: high scores first, ties by smaller id."""
    order = np.lexsort((vec_id, -score, anchor))
    of = anchor[order]
    first = np.searchsorted(of, of)
    return order[np.arange(len(of)) - first < most]


def _first(estimate: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of the matrix the allowed places with the highest estimates."""
    masked = np.where(allowed, estimate, -np.inf)
    most = min(most, masked.shape[1])
    at = np.argpartition(masked, masked.shape[1] - most, axis=1)[:, masked.shape[1] - most :]
    i = np.repeat(np.arange(len(masked)), most)
    keep = np.isfinite(masked[i, at.ravel()])
    return i[keep], at.ravel()[keep]


def _kth(i: np.ndarray, score: np.ndarray, n: int, most: int) -> np.ndarray:
    """The ``most``-th highest score of each of ``n`` anchors, or no bound."""
    out = np.full(n, NONE)
    order = np.lexsort((-score, i))
    of = i[order]
    nth = order[np.arange(len(of)) - np.searchsorted(of, of) == most - 1]
    out[i[nth]] = score[nth]
    return out


def nearest(q: np.ndarray, asked: onebit.Queries, q_ids: np.ndarray, x: np.ndarray, codes: onebit.Codes, x_ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the best ``most`` rows with another id for every query."""
    estimate, half = onebit.intervals(asked, codes)
    other = q_ids[:, None] != x_ids[None, :]
    i, j = _first(estimate, other, PROBE * most)
    bound = _kth(i, products(q, x, i, j), len(q), most)
    i, j = np.nonzero(other & (estimate + half >= bound[:, None]))
    score = products(q, x, i, j)
    best = _best(i, score, x_ids[j], most)
    return i[best], j[best], score[best]


def banded(
    q: np.ndarray, asked: onebit.Queries, q_labels: np.ndarray, least: np.ndarray, top: np.ndarray, x: np.ndarray, codes: onebit.Codes, x_ids: np.ndarray, x_labels: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band, i, j, score) of the best ``most`` rows of another label with least <= score <= top, for every query and each of
    its bands (queries x bands; a band that ends before it begins has none)."""
    estimate, half = onebit.intervals(asked, codes)
    other = q_labels[:, None] != x_labels[None, :]
    upper, lower = estimate + half, estimate - half
    open_ = np.zeros(estimate.shape, bool)
    bounds = []
    for b in range(least.shape[1]):
        low, high = least[:, b, None], top[:, b, None]
        meets = other & (low <= high) & (upper >= low) & (lower <= high)
        i, j = _first(estimate, meets & (estimate <= high), PROBE * most)
        score = products(q, x, i, j)
        inside = (score >= least[i, b]) & (score <= top[i, b])
        bound = np.maximum(_kth(i[inside], score[inside], len(q), most), least[:, b])
        bounds.append(bound)
        open_ |= meets & (upper >= bound[:, None])
    i, j = np.nonzero(open_)
    score = products(q, x, i, j)
    out = []
    for b, bound in enumerate(bounds):
        inside = np.flatnonzero((score >= bound[i]) & (score <= top[i, b]))
        best = inside[_best(i[inside], score[inside], x_ids[j[inside]], most)]
        out.append((np.full(len(best), b), i[best], j[best], score[best]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _grid(rows: DataFrame, anchors: DataFrame, cell_rows: int, cell_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt into cells: rows once for every cell of anchors, anchors once for every cell of rows."""
    across, down = (max(1, math.ceil(t.count() / n)) for t, n in ((rows, cell_rows), (anchors, cell_anchors)))
    of_row = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(across))
    of_anchor = F.pmod(F.xxhash64("anchor_id", "anchor_key"), F.lit(down))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("x", of_row.cast("int")).withColumn("y", every(down))
    return rows, anchors.withColumn("y", of_anchor.cast("int")).withColumn("x", every(across))


def _meet(rows: DataFrame, anchors: DataFrame, found, schema: str) -> DataFrame:
    keys = ["dim", "x", "y"]
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(found, schema)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    levels: int = onebit.LEVELS,
    cell_rows: int = CELL_ROWS,
    cell_anchors: int = CELL_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's first positives.

    ``vectors`` has vec_id, label and vector (array<long>); other columns are ignored. ``anchor`` tells the anchors by their
    columns. A row's score is its integer inner product with the anchor. Positives are the first ``positives`` rows of the
    anchor's label, negatives of a positive the first ``negatives`` of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score: high scores first, ties by smaller id. Rows with a
    null id, label or vector, or a null in it, take no part. Rows that are equal throughout count once; other rows with one
    id stand for themselves, and an anchor never meets its own id among the positives. Vectors of different lengths never
    meet. A score beyond 64 bits is an error. No rows give no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    whole = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(~F.exists("vector", lambda v: v.isNull()))
    rows = written(coded(whole.distinct().withColumn("dim", F.size("vector")), levels), "codes")
    anchors = rows.where(anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vector").alias("anchor_key"), "label", "dim", "vector")

    def same(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            x, codes, ids, labels = _matrix(left["vector"], dim), _codes(left, levels), left["vec_id"].to_numpy(), left["label"].to_numpy()
            q, q_ids, q_labels = _matrix(right["vector"], dim), right["anchor_id"].to_numpy(), right["label"].to_numpy()
            order = np.argsort(labels, kind="stable")
            sorted_labels = labels[order]
            for label in np.unique(q_labels).tolist():
                mine = order[np.searchsorted(sorted_labels, label) : np.searchsorted(sorted_labels, label, "right")]
                all_ = np.flatnonzero(q_labels == label)
                if not len(mine):
                    continue
                near = codes.take(mine)
                for at in np.array_split(all_, math.ceil(len(all_) / BLOCK)):
                    i, j, score = nearest(q[at], onebit.ask(q[at], levels), q_ids[at], x[mine], near, ids[mine], positives)
                    out.append((at[i], ids[mine][j], score))
        return _hits(right, out)

    def _hits(right: pa.Table, out: list) -> pa.Table:
        i, other, score = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
        return pa.table([right["anchor_id"].take(pa.array(i)), right["anchor_key"].take(pa.array(i)), pa.array(other, pa.int64()), pa.array(score, pa.int64())], names=[f.split()[0] for f in HIT.split(", ")])

    order = [F.col("score").desc(), F.col("other_id")]
    by_anchor = Window.partitionBy("anchor_id", "anchor_key")
    found = _meet(*_grid(rows, anchors, cell_rows, cell_anchors), same, HIT).withColumn("place", F.row_number().over(by_anchor.orderBy(*order))).where(F.col("place") <= positives)
    chosen = found.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("p"))
    chosen = written(anchors.join(chosen, ["anchor_id", "anchor_key"]), "positives")

    def other(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            x, codes, ids, labels = _matrix(left["vector"], dim), _codes(left, levels), left["vec_id"].to_numpy(), left["label"].to_numpy()
            q, q_labels = _matrix(right["vector"], dim), right["label"].to_numpy()
            scores = [[p["score"] for p in row] for row in right["p"].to_pylist()]
            least, top = np.zeros((len(scores), positives), np.int64), np.full((len(scores), positives), -1)
            for i, row in enumerate(scores):
                for b, s in enumerate(row):
                    least[i, b], top[i, b] = -(-low * s // 100), high * s // 100
            for at in np.array_split(np.arange(len(q)), math.ceil(len(q) / BLOCK)):
                b, i, j, score = banded(q[at], onebit.ask(q[at], levels), q_labels[at], least[at], top[at], x, codes, ids, labels, negatives)
                out.append((at[i], b, ids[j], score))
        i, b, hit, score = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(4))
        i = pa.array(i)
        return pa.table(
            [right["anchor_id"].take(i), right["anchor_key"].take(i), pa.array(b, pa.int32()), pa.array(hit, pa.int64()), pa.array(score, pa.int64())],
            names=["anchor_id", "anchor_key", "band", "negative_id", "negative_score"],
        )

    hits = _meet(*_grid(rows, chosen, cell_rows, cell_anchors), other, "anchor_id long, anchor_key long, band int, negative_id long, negative_score long")
    by_pair = Window.partitionBy("anchor_id", "anchor_key", "band").orderBy(F.col("negative_score").desc(), F.col("negative_id"))
    hits = hits.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    pair = F.get(F.col("p"), F.col("band"))
    return hits.join(chosen.select("anchor_id", "anchor_key", "p"), ["anchor_id", "anchor_key"]).select(
        "anchor_id", pair["other_id"].alias("positive_id"), "rank", "negative_id", pair["score"].alias("positive_score"), "negative_score"
    )
