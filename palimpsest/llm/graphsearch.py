"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard, searched with a beam.

Rows are dealt by hash into shards of bounded size. In a shard points enter the graph in batches: a greedy search from the
entry point proposes a point's neighbours, relaxed pruning keeps those that no kept one is much nearer to, and edges back
are added and pruned the same way. Queries go to every shard in blocks; what the beam holds at its end is scored again in
double precision on the vectors as given. Equal vectors are one point of the graph with their smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import rolling
from palimpsest.llm.shared import written

NEIGHBOURS = 5
SHARD_ROWS = 8192
QUERY_ROWS = 8192
DEGREE = 32
BEAM = 64  # while the graph is built
SEARCH_BEAM = 160
RELAXED = 1.2
BATCH = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; large and small rows first by a power of two."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: of each row of ``q`` to its own rows of ``x``."""
    return 2 - 2 * np.einsum("nd,nkd->nk", q, x)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and distances (queries x beam, near ones first; -1 where fewer were met). All queries advance together, and each
    expands the nearest point of its beam not expanded yet, until there is none."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    met = np.zeros((n, len(x)), bool)
    ids[:, 0], met[:, entry] = entry, True
    far[:, 0] = 2 - 2 * (q @ x[entry])
    live = np.arange(n)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        at = open_.argmax(axis=1)  # the beam is sorted
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~met[live[:, None], near]
        row, col = np.nonzero(fresh)
        met[live[row], near[row, col]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[row, col] = 2 - 2 * np.einsum("nd,nd->n", q[live[row]], x[near[row, col]])
        both = np.concatenate([far[live], d], axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(both, best, axis=1)
        ids[live] = np.where(np.isfinite(far[live]), np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1), -1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1), best, axis=1)
    return ids, far


def robust_prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """The neighbours (points x degree, -1 filled) kept of candidates ``ids`` (points x any number, -1 filled).

    Near ones first; one that is kept drops the candidates to which it is nearer than the point is, by the relaxed factor.
    """
    ids = np.where(ids == points[:, None], -1, ids)
    far = np.where(ids >= 0, _distances(x[points], x[ids]), np.inf)
    order = np.lexsort((ids, far), axis=1)
    ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
    alive = np.isfinite(far)
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    near = x[ids]
    between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
    kept = np.full((len(points), degree), -1, np.int32)
    count = np.zeros(len(points), np.int64)
    for c in range(ids.shape[1]):
        now = np.flatnonzero(alive[:, c] & (count < degree))
        kept[now, count[now]] = ids[now, c]
        count[now] += 1
        alive[now] &= relaxed * relaxed * between[now, c] > far[now]
    return kept


def _back(x: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, relaxed: float) -> None:
    """Edges back to ``points`` from their neighbours; a neighbour with too many is pruned."""
    source = np.repeat(points, degree)
    target = graph[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((source, target))
    source, target = source[order].astype(np.int32), target[order]
    ends, first, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(ends), BATCH):
        these, n = ends[at : at + BATCH], count[at : at + BATCH]
        wide = np.full((len(these), int(n.max())), -1, np.int32)
        row = np.repeat(np.arange(len(these)), n)
        begin = first[at : at + BATCH]
        wide[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = source[begin[0] : begin[0] + len(row)]
        for part in range(0, wide.shape[1], 2 * degree):  # a hub's new edges a few at a time
            both = np.concatenate([graph[these], wide[:, part : part + 2 * degree]], axis=1)
            more = (wide[:, part : part + 2 * degree] >= 0).any(axis=1)
            graph[these[more]] = robust_prune(x, these[more], both[more], degree, relaxed)


def reached(graph: np.ndarray, entry: int) -> np.ndarray:
    """Which points some path of edges leads to."""
    seen = np.zeros(len(graph), bool)
    seen[entry] = True
    last = np.array([entry])
    while len(last):
        ends = graph[last]
        last = np.unique(ends[(ends >= 0)])
        last = last[~seen[last]]
        seen[last] = True
    return seen


def _rejoined(x: np.ndarray, graph: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """The graph with one more edge to each point that pruning has cut off, from the nearest point that a search finds."""
    while len(lost := np.flatnonzero(~reached(graph, entry))):
        lost = lost[:BATCH]
        ids, _ = beam_search(x, graph, entry, x[lost], beam)
        order = np.argsort(ids[:, 0], kind="stable")
        source, lost = ids[order, 0], lost[order]
        slot = (graph[source] >= 0).sum(axis=1) + np.arange(len(source)) - np.searchsorted(source, source)
        if (more := int(slot.max()) + 1 - graph.shape[1]) > 0:
            graph = np.concatenate([graph, np.full((len(graph), more), -1, np.int32)], axis=1)
        graph[source, slot] = lost
    return graph


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED) -> tuple[np.ndarray, int]:
    """Neighbours (a row for each point, -1 filled at its end) and entry point of unit vectors (float32). Points enter in a fixed
    random order, in batches that grow with the graph; at the end every point can be reached."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.argsort(rolling.mix(np.arange(1, n + 1, dtype=np.uint64)), kind="stable")
    order = order[order != entry]
    at = 0
    while at < len(order):
        points = order[at : at + min(BATCH, max(1, at))]
        ids, _ = beam_search(x, graph, entry, x[points], beam)
        graph[points] = robust_prune(x, points, ids, degree, relaxed)
        _back(x, graph, points, degree, relaxed)
        at += len(points)
    return _rejoined(x, graph, entry, beam), entry


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, each pair summed on its own, so that equal rows have equal scores."""
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None]) for v in (q, x))
    return (q * x).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1))


def _matrix(rows: pa.ChunkedArray, dim: int) -> np.ndarray:
    return rows.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def points_of(vectors: DataFrame, most: int) -> DataFrame:
    """(key, dim, vector, ids): the different vectors, each with its ``most`` smallest ids."""
    vectors = vectors.withColumn("key", F.xxhash64("vector"))
    nth = F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))
    few = vectors.distinct().withColumn("nth", nth).where(F.col("nth") <= most)
    return few.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))


def graphs(points: DataFrame, shard_rows: int, degree: int, beam: int, relaxed: float) -> DataFrame:
    """(shard, dim, entry, neighbours, ids, vector): the points of every shard with their neighbours, as positions in the shard."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("first", "ascending")])
        x = unit(_matrix(part["vector"], key[0].as_py())).astype(np.float32)
        graph, entry = build(x, degree, beam, relaxed)
        near = pa.array([row[row >= 0] for row in graph], pa.list_(pa.int32()))
        n = part.num_rows
        return pa.table([part["shard"], part["dim"], pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, entry), pa.int32()), near, part["ids"], part["vector"]], names=["shard", "dim", "place", "entry", "near", "ids", "vector"])

    shards = max(1, math.ceil(points.count() / shard_rows))
    dealt = points.select("key", "dim", "vector", "ids", F.col("ids")[0].alias("first"), F.pmod(F.hash("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, "shard int, dim int, place int, entry int, near array<int>, ids array<long>, vector array<double>")


def neighbours(
    vectors: DataFrame,
    query: Column,
    most: int = NEIGHBOURS,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    degree: int = DEGREE,
    build_beam: int = BEAM,
    beam: int = SEARCH_BEAM,
    relaxed: float = RELAXED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` rows of largest cosine found for each query, ties by smaller id.

    ``vectors`` has vec_id and vector (an array of numbers); other columns are ignored. ``query`` tells the queries by vec_id.
    Rows with a null id take no part, nor do vectors that are null, empty, zero or hold null or non-finite components. Rows equal
    throughout count once; other rows with one id stand for themselves, and a query never meets its own id. Vectors of
    different lengths never meet. With fewer candidates all are returned. No rows give no rows.
    """
    x = F.col("vector")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    points = written(points_of(vectors, most + 1), "points")
    shards = written(graphs(points, shard_rows, degree, build_beam, relaxed), "graph")
    queries = vectors.where(query).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), F.size("vector").alias("dim"), "vector")
    asked = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(asked)).cast("int"))
    there = shards.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    right = queries.join(there, "dim")

    def run(key, part: pa.Table, asked: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        if part.num_rows and asked.num_rows:
            part = part.sort_by("place")
            whole, q_whole = _matrix(part["vector"], dim), _matrix(asked["vector"], dim)
            x, q, own = unit(whole).astype(np.float32), unit(q_whole).astype(np.float32), asked["query_id"].to_numpy()
            near = part["near"].combine_chunks()
            sizes = near.value_lengths().to_numpy()
            graph = np.full((len(x), max(1, int(sizes.max()))), -1, np.int32)
            row = np.repeat(np.arange(len(x)), sizes)
            graph[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = near.flatten().to_numpy()
            ids = part["ids"].combine_chunks()
            starts, flat = np.cumsum(ids.value_lengths().to_numpy()) - ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            counts = ids.value_lengths().to_numpy()
            for at in range(0, len(q), BATCH):
                found, _ = beam_search(x, graph, part["entry"][0].as_py(), q[at : at + BATCH], max(beam, most + 1))
                i, c = np.nonzero(found >= 0)
                j = found[i, c]
                score = cosines(q_whole[at + i], whole[j])
                n = counts[j]
                i, score = np.repeat(at + i, n), np.repeat(score, n)
                vec = flat[np.repeat(starts[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                keep = vec != own[i]
                i, score, vec = i[keep], score[keep], vec[keep]
                order = np.lexsort((vec, -score, i))
                of = i[order]
                best = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
                out.append((i[best], vec[best], score[best]))
        i, vec, score = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
        i = pa.array(i)
        return pa.table([asked["query_id"].take(i), asked["query_key"].take(i), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "query_key", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
