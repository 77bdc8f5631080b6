"""Vector search, hit selection and transcript reassembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.ordered import join_ordered, top_per_key
from palimpsest.session import checkpointed

TOP_K, QUERY_BLOCK, VECTOR_BLOCK = 12, 1024, 4096
TILE = 8  # blocks of vectors of one cell that meet a block of queries together
PLANES = 4  # cells: one for each combination of sides


def vector_filter(vectors: DataFrame, condition: Column | str) -> DataFrame:
    """Metadata predicate before scoring; Parquet sees it when the columns are stored."""
    return vectors.where(condition)


def _celled(df: DataFrame, key: str, planes: int) -> DataFrame:
    """(key, dim, cell, unit): vectors scaled to length one, and the side on which they lie of a few fixed planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                x = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                normals = np.cos(np.outer(np.arange(1, dim + 1) ** 2, np.arange(1, planes + 1) * np.sqrt(2.0)))
                cell = ((x @ normals > 0) << np.arange(planes)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(at), pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=[key, "dim", "cell", "unit"]
                )

    rows = df.select(key, F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, dim int, cell int, unit binary")


def _packed(df: DataFrame, key: str, rows: int, planes: int) -> DataFrame:
    """(block, dim, cell, nth, ids, units, centre, radius): blocks of up to about ``rows`` vectors of one cell, with the unit vector of their
    mean and the largest angle to it."""

    def run(key_: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        dim, cell, nth = (k.as_py() for k in key_)
        units = b"".join(part["unit"].to_pylist())
        x = np.frombuffer(units).reshape(part.num_rows, dim)
        centre = x.mean(axis=0) if part.num_rows else np.zeros(dim)
        length = np.sqrt((centre * centre).sum())
        whole = length < 1e-12 or (np.abs(x).max(axis=1, initial=0) == 0).any()
        centre = centre / max(length, 1e-300)
        radius = math.pi if whole else float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        ids = part[key].combine_chunks()
        ids = ids if not isinstance(ids, pa.ChunkedArray) else pa.concat_arrays(ids.chunks)
        return pa.table(
            [pa.array([f"{dim}:{cell}:{nth}"]), *[pa.array([v], pa.int32()) for v in (dim, cell, nth)], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([units], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
            names=["block", "dim", "cell", "nth", "ids", "units", "centre", "radius"],
        )

    celled = _celled(df, key, planes)
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("parts"))
    placed = celled.join(parts, ["dim", "cell"]).withColumn("nth", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    kind = dict(df.dtypes)[key]
    return placed.select(key, "dim", "cell", "nth", "unit").groupBy("dim", "cell", "nth").applyInArrow(run, f"block string, dim int, cell int, nth int, ids array<{kind}>, units binary, centre binary, radius double")


def _best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of everything at or above the k-th score of each query: ties are settled by id later."""
    rough = q @ x.T
    if rough.shape[1] > k:
        floor = np.partition(rough, -k, axis=1)[:, -k] - 1e-9
        i, j = np.nonzero(rough >= floor[:, None])
    else:
        i, j = np.indices(rough.shape).reshape(2, -1)
    return i, j, (q[i] * x[j]).sum(axis=1)  # each pair summed on its own: equal vectors have equal scores


def _best_of(q: np.ndarray, x: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of ``rows`` vectors at a time; what falls below the k-th score of all is dropped."""
    parts = [(i, j + at, s) for at in range(0, max(len(x), 1), rows) for i, j, s in [_best(q, x[at : at + rows], k)]]
    i, j, scores = (np.concatenate(p) for p in zip(*parts))
    if len(parts) > 1:
        order = np.lexsort((-scores, i))
        i, j, scores = i[order], j[order], scores[order]
        first = np.searchsorted(i, np.arange(len(q)))
        last = np.minimum(first + k, np.append(first[1:], len(i))) - 1
        keep = ~(scores < scores[last[i]])
        i, j, scores = i[keep], j[keep], scores[keep]
    return i, j, scores


def _unpack(units: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(units).reshape(-1, dim) if dim else np.empty((0, 0))


def _needed(asked: DataFrame, blocks: DataFrame, k: int, planes: int, rows: int = VECTOR_BLOCK) -> DataFrame:
    """(block, asker, need, n): which queries of a block of queries must see which block of vectors.

    The first ``rows`` vectors of a query's own cell give a score that its k-th best is not below. The angle to any vector of a block
    is at least that to its centre less its radius, so a block whose best possible score is below is not needed.
    """
    near = blocks.where("nth = 0").select("dim", "cell", F.col("units").alias("there"))
    mine = asked.select(F.col("block").alias("asker"), "dim", "cell", "units").join(near, ["dim", "cell"], "left")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, units, there in zip(*(batch.column(c).to_pylist() for c in ("dim", "units", "there"))):
                q = _unpack(units, dim)
                scores = q @ _unpack(there, dim)[:rows].T if there else np.empty((len(q), 0))
                out.append((np.partition(scores, -k, axis=1)[:, -k] - 1e-9 if scores.shape[1] >= k else np.full(len(q), -2.0)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("asker"), batch.column("dim"), batch.column("units"), pa.array(out, pa.binary())], names=["asker", "dim", "units", "floor"])

    floored = mine.mapInArrow(floors, "asker string, dim int, units binary, floor binary")
    every = floored.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit((1 << planes) - 1))))
    met = every.join(blocks.select("block", "dim", "cell", "centre", "radius"), ["dim", "cell"])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for dim, units, floor, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("dim", "units", "floor", "centre", "radius"))):
                q = _unpack(units, dim)
                angle = np.arccos(np.clip(q @ np.frombuffer(centre), -1, 1)) - radius
                top = np.where((radius >= math.pi) | ~q.any(axis=1), 1.0, np.cos(np.maximum(angle, 0)))
                out.append(np.flatnonzero(top + 1e-9 >= np.frombuffer(floor)).astype(np.int32))
                counts.append(len(q))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("asker"), pa.array(out, pa.list_(pa.int32())), pa.array(counts, pa.int32())], names=["block", "asker", "need", "n"])

    return met.mapInArrow(needs, "block string, asker string, need array<int>, n int")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK, rows: int = VECTOR_BLOCK, planes: int = PLANES, tile: int = TILE) -> DataFrame:
    """Exact top-k by cosine for every query vector: (query_id, id, score, rank), ranked by the full score, ties by id; scores are
    shown to six places.

    Vectors and queries are packed into blocks of neighbouring vectors; a block of queries meets a block of vectors in one
    task, and only if a bound on its scores does not rule it out (``skipped_share`` tells how much that saves). Up to ``tile`` blocks of a
    cell travel as one, so a query is sent to few of them, and are scored ``rows`` vectors at a time. Null
    vectors take no part, vectors of different lengths never meet, and a zero vector has score 0 with all.
    """
    asked, blocks = (checkpointed(_packed(d, c, n, planes)) for d, c, n in ((queries, "query_id", block), (vectors, "id", rows * tile)))
    pairs = _needed(asked, blocks, k, planes, rows).where(F.size("need") > 0).select("block", "asker", "need")
    met = pairs.join(asked.select(F.col("block").alias("asker"), F.col("ids").alias("query_ids"), F.col("units").alias("query_units")), "asker")
    met = met.join(blocks.select("block", "dim", "ids", "units"), "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, need = batch.column("dim")[r].as_py(), batch.column("need")[r].values.to_numpy()
                q, x = (_unpack(batch.column(c)[r].as_py(), dim) for c in ("query_units", "units"))
                i, j, scores = _best_of(q[need], x, k, rows)
                found = [batch.column("query_ids")[r].values.take(pa.array(need[i])), batch.column("ids")[r].values.take(pa.array(j)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(found, names=["query_id", "id", "score"])

    scored = met.mapInArrow(score, f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, score double")
    ranked = top_per_key(scored, ["query_id"], [F.desc("score"), "id"], k, rank="rank")
    return ranked.withColumn("score", F.round("score", 6))


def skipped_share(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK, rows: int = VECTOR_BLOCK, planes: int = PLANES, tile: int = TILE) -> DataFrame:
    """One row: pairs of a query and a block of vectors, and how many of them ``vector_topk`` leaves out."""
    need = _needed(_packed(queries, "query_id", block, planes), checkpointed(_packed(vectors, "id", rows * tile, planes)), k, planes, rows)
    return need.agg(F.sum("n").alias("pairs"), F.sum(F.col("n") - F.size("need")).alias("skipped"))


def select_hits(
    hits: DataFrame, now: Column, rmin: int = 0, rmax: int = 3, half_life_h: float = 168.0,
    alpha: float = 0.7, beta: float = 0.25, gamma: float = 0.2, knee: float = 0.25, clip: float = 0.01, accept: float = 0.35,
) -> DataFrame:
    """Walk the hits of a query best first and choose some: (query_id, id, score, composite, place).

    ``hits`` holds at most top-k rows per query (query_id, id, score, rank, start_ts). The previous score moves
    only when a hit is chosen, so the walk is a fold, not a window.
    """
    rec = X.recency_weight("start_ts", now, half_life_h)
    packed = F.array_sort(F.collect_list(F.struct("rank", "id", "score", rec.alias("rec"))))
    per = hits.groupBy("query_id").agg(packed.alias("h"), F.max("score").alias("top"))
    top = F.when(F.col("top") == 0, 1e-9).otherwise(F.col("top"))
    idt = dict(hits.dtypes)["id"]
    begin = F.struct(F.array().cast(f"array<struct<composite:double,rank:int,id:{idt},score:double>>").alias("chosen"), F.col("t").alias("prev"), F.lit(False).alias("stop"))

    def step(a, h):
        s_norm = F.greatest(F.least(h["score"] / F.col("t"), F.lit(1.0)), F.lit(0.0))
        drop = F.greatest((a["prev"] - h["score"]) / F.greatest(a["prev"], F.lit(1e-9)), F.lit(0.0))
        comp = F.round(alpha * s_norm + beta * h["rec"] - gamma * drop, 9)
        n = F.size(a["chosen"])
        take = (n < rmin) | (comp >= accept)
        more = F.concat(a["chosen"], F.array(F.struct(comp.alias("composite"), h["rank"].alias("rank"), h["id"].alias("id"), h["score"].alias("score"))))
        chosen = F.when(take, more).otherwise(a["chosen"])
        halt = (~take & (drop >= knee) & (n >= rmin)) | (F.size(chosen) >= rmax)
        moved = F.struct(chosen.alias("chosen"), F.when(take, h["score"]).otherwise(a["prev"]).alias("prev"), halt.alias("stop"))
        ended = F.struct(a["chosen"], a["prev"], F.lit(True).alias("stop"))
        return F.when(a["stop"], a).when(h["score"] < clip, ended).otherwise(moved)

    chosen = F.aggregate("h", begin, step, lambda a: a["chosen"])
    by_composite = F.array_sort(F.transform(chosen, lambda c: F.struct((-c["composite"]).alias("neg"), c["rank"].alias("rank"), c["id"].alias("id"), c["score"].alias("score"))))
    return (
        per.withColumn("t", top)
        .select("query_id", F.posexplode(by_composite).alias("place", "c"))
        .select("query_id", "place", F.col("c.id").alias("id"), F.col("c.score").alias("score"), (-F.col("c.neg")).alias("composite"))
    )


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First hit per content: by hash, else similarity hash, else a hash of the text."""
    sig = F.coalesce(F.nullif("hash", F.lit("")), F.nullif("simhash64", F.lit("")), F.sha1(F.coalesce("chunk_text", F.lit(""))))
    return top_per_key(hits.withColumn("sig", sig), ["query_id", "sig"], ["place"], 1)


_STAMP = r"\[(\d{6}\w{3} \d{2}:\d{2})\]"


def merge_hit_lines(hits: DataFrame, gap_minutes: int = 5) -> DataFrame:
    """One text per query: lines of its (few) hits in time order; a stamp too close to the last kept one goes."""
    lines = F.filter(F.split(F.regexp_replace("chunk_text", r"(?U)^\s+|\s+$", ""), r"\r?\n"), lambda x: x != "")
    packed = F.array_sort(F.collect_list(F.struct("start_ts", "place", lines.alias("l"))))
    per = hits.groupBy("query_id").agg(F.flatten(F.transform(packed, lambda h: h["l"])).alias("lines"))

    def step(a, line):
        m = F.regexp_extract(line, _STAMP, 1)
        at = F.unix_timestamp(F.concat(F.substring(m, 1, 6), F.substring(m, 10, 6)), "yyMMdd HH:mm")
        keep = a["last"].isNull() | (at - a["last"] >= gap_minutes * 60)
        bare = F.regexp_replace(F.regexp_replace(line, _STAMP, ""), r"^\s+", "")
        put = lambda t, last: F.struct(F.concat(a["out"], F.array(t)).alias("out"), last.alias("last"))
        return F.when(m == "", put(line, a["last"])).when(keep, put(line, at)).otherwise(put(bare, a["last"]))

    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("long").alias("last"))
    return per.select("query_id", F.array_join(F.aggregate("lines", begin, step, lambda a: a["out"]), "\n").alias("text"))


def unpack_transcript(texts: DataFrame, key: str, col: str, roles: tuple[str, str] = ("User", "Assistant")) -> DataFrame:
    """Lines ``[stamp] Role: text`` to rows (key, msg_no, role, content); other lines continue the row before.

    A text is unpacked within its row: nothing is shuffled.
    """
    head = rf"^(?:\[(\d{{6}}\w* \d{{2}}:\d{{2}})\]\s*)?({'|'.join(roles)}):\s*(.*)$"
    body = F.regexp_replace(col, r"^\[Memory v2\]\s*", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), X.trim_ws), lambda x: x != "")

    def step(a, line):
        is_head = F.regexp_like(line, F.lit(head))
        stamp, who, text = (F.regexp_extract(line, head, i) for i in (1, 2, 3))
        shown = F.when(stamp != "", F.concat(F.lit("["), stamp, F.lit("] "), F.trim(text))).otherwise(F.trim(text))
        role = F.when(who == roles[1], "assistant").otherwise("user")
        last = F.element_at(a, -1)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit("\n"), line).alias("content"))))
        return F.when(is_head, F.concat(a, F.array(F.struct(role.alias("role"), shown.alias("content"))))).when(F.size(a) > 0, longer).otherwise(a)

    rows = F.aggregate(lines, F.array().cast("array<struct<role:string,content:string>>"), step)
    return texts.select(key, F.posexplode(rows).alias("msg_no", "m")).select(key, "msg_no", "m.role", "m.content")


def dedupe_lines(rows: DataFrame, key: str) -> DataFrame:
    """First occurrence of each line over a whole transcript, whoever said it; emptied rows go."""
    lines = rows.select(key, "msg_no", "role", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    bare = F.regexp_replace("line", r"^\[(\d{6}\w* \d{2}:\d{2})\]\s*", "")
    lines = lines.withColumn("norm", X.trim_ws(F.regexp_replace(bare, r"\s+", " "))).where("norm <> ''")
    first = lines.groupBy(key, "norm").agg(F.min(F.struct("msg_no", "line_no", "role", "line")).alias("f"))
    return first.groupBy(key, F.col("f.msg_no").alias("msg_no"), F.col("f.role").alias("role")).agg(join_ordered(F.col("f.line"), [F.col("f.line_no")], "\n").alias("content"))


def memory_cap(text: Column | str, limit: int = 6000) -> Column:
    """The recalled text as a memory block, cut to ``limit`` characters; null when there is nothing."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c != "", F.substring(X.trim_ws(F.concat(F.lit("[Memory v2] "), c)), 1, limit))


def memory_splice(system: DataFrame, recalled: DataFrame, history: DataFrame) -> DataFrame:
    """System rows, then recalled rounds, then history: sort by (section, ord)."""
    tag = lambda df, n: df.withColumn("section", F.lit(n))
    return tag(system, 0).unionByName(tag(recalled, 1)).unionByName(tag(history, 2))
