"""Connected components of an edge table, and settling a graph component by component."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

TASK_EDGES = 200_000


def _hung(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least) for every node of the edges that is not the least of those it is connected with."""
    near = defaultdict(list)
    for a, b in rows:
        near[a].append(b)
        near[b].append(a)
    out, seen = [], set()
    for start in sorted(near):  # the first node met of a component is its least
        if start in seen:
            continue
        seen.add(start)
        todo = [start]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
                    out.append((x, start))
    return out


def _within_tasks(edges: DataFrame, most: int) -> DataFrame:
    """Edges solved ``most`` at a time, or a batch of them: no more are held, however many a task has."""

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hung = _hung([pair for b in held for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        for at in range(0, len(hung), 1 << 16):
            part = hung[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > most:
                yield from solved(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        yield from solved(held)

    return edges.mapInArrow(run, "a long, b long")


def _rehung(edges: DataFrame, up: bool) -> DataFrame:
    """Neighbours above a node (``up``), or the node and those below it, are joined to the least of its neighbourhood."""
    ends = edges.union(edges.select("b", "a").toDF("a", "b")) if up else edges
    least = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = ends.join(least, "a")
    if up:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return met.select(F.col("b").alias("a"), "m").union(least.select("a", "m")).where("a <> m").toDF("a", "b").distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: integers): the root is the least node connected with it.

    Each task first solves the edges it holds; what lies in several tasks is joined in rounds whose number grows with the
    logarithm of the longest path. Edges of a node with itself and nulls are ignored.
    """
    down = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    cur = checkpointed(down)
    tasks = max(1, math.ceil(cur.count() / task_edges))
    cur = checkpointed(_within_tasks(cur.coalesce(tasks), task_edges))
    while tasks > 1:
        after = checkpointed(_within_tasks(_rehung(_rehung(cur, True), False).coalesce(tasks), task_edges))
        same = after.join(cur, ["a", "b"], "left_anti").isEmpty() and cur.join(after, ["a", "b"], "left_anti").isEmpty()
        cur = after
        if same:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())
