"""Connected components by alternating large-star and small-star, and linking inside buckets through hubs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import checkpointed


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    """Join every node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(out.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _divided(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or hangs on one while others hang on it: the edges are no stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def _contracted(edges: DataFrame) -> DataFrame:
    """Within each task the edges become stars: every node of a part that they connect hangs on the smallest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top.setdefault(top[x], top[x])
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                u, v = find(u), find(v)
                top[max(u, v)] = min(u, v)
        stars = [(x, find(x)) for x in list(top)]
        stars = [(x, root) for x, root in stars if x != root]
        for at in range(0, len(stars), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars[at : at + (1 << 16)]], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame, task_edges: int = 200_000) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node that it reaches.

    Tasks of about ``task_edges`` edges contract what they hold before each round, the stars' rounds connect what lies in
    several tasks. The rounds grow with the logarithm of the longest path. Each is cut off by a checkpoint. No links give no
    rows; links of a node with itself and nulls are ignored.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v"))
    tasks = max(1, math.ceil(edges.count() / task_edges))  # no round makes edges more
    edges = checkpointed(_contracted(edges.coalesce(tasks)))
    while tasks > 1 and _divided(edges):
        edges = checkpointed(_contracted(small_star(large_star(edges)).coalesce(tasks)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def shared(index: DataFrame, probe: DataFrame) -> DataFrame:
    """(bucket, node) of all buckets of ``index`` that a further node of ``probe`` meets; every index row is a probe, too."""
    hubs = index.groupBy("bucket").agg(F.min("node").alias("hub"))
    met = probe.join(hubs, "bucket").where("node <> hub")
    return checkpointed(met.select("bucket", "node").union(met.select("bucket", F.col("hub").alias("node"))).distinct())


def _blocks(dense: DataFrame, size: int) -> DataFrame:
    """(group, a, b, side, node, root): the nodes of every two blocks of a bucket that must be compared.

    Of buckets with the same nodes (two 64-bit sums of hashes and the number of nodes agree) one is the group. A component with
    enough nodes in its group has blocks of its own, all other nodes share mixed ones; a node's place in them is a hash, so
    no task sorts a group. Two blocks of one component are not compared. Side 0 and 1 tell the blocks apart; a block compared
    with itself is side 0 alone.
    """
    sets = dense.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"))
    groups = sets.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    placed = dense.join(groups, "bucket").select(F.col("bucket").alias("group"), "node", "root")
    counts = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    class_ = F.when(F.col("n") >= size, F.col("root").cast("string")).otherwise("mixed")
    counts = checkpointed(counts.select("group", "root", class_.alias("class"), "n"))
    classes = counts.groupBy("group", "class").agg(F.ceil(F.sum("n") / size).alias("blocks"))
    of = F.concat_ws(":", "class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string"))
    placed = checkpointed(placed.join(counts.select("group", "root", "class"), ["group", "root"]).join(classes, ["group", "class"]).select("group", "node", "root", of.alias("block")))
    blocks = classes.select("group", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    blocks = blocks.select("group", "class", F.concat_ws(":", "class", F.col("i").cast("string")).alias("block"))
    left, right = (blocks.select("group", F.col("class").alias(f"class_{x}"), F.col("block").alias(x)) for x in "ab")
    pairs = left.join(right, "group").where("a <= b AND NOT (class_a = class_b AND class_a <> 'mixed')").select("group", "a", "b")
    first = pairs.join(placed.withColumnRenamed("block", "a"), ["group", "a"]).withColumn("side", F.lit(0))
    second = pairs.where("a <> b").join(placed.withColumnRenamed("block", "b"), ["group", "b"]).withColumn("side", F.lit(1))
    return first.unionByName(second).select("group", "a", "b", "side", "node", "root")


def spanning(found: Iterable[tuple[int, int]], nodes: list[int], roots: list[int]) -> list[tuple[int, int]]:
    """Those of the links (positions in ``nodes``) that join parts not joined before, by roots or by earlier links."""
    parent = {r: r for r in roots}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in found:
        x, y = top(roots[i]), top(roots[j])
        if x != y:
            parent[x] = y
            out.append((nodes[i], nodes[j]))
    return out


def _compared(blocks: DataFrame, payload: DataFrame, similar: Callable[[list, list | None], tuple]) -> DataFrame:
    """Links (a, b) found in two blocks at a time. ``similar`` gives the similar positions of two lists of payloads."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        n = table.num_rows - int(pc.sum(table["side"]).as_py())  # rows of side 0
        data, nodes, roots = (table[c].to_pylist() for c in ("payload", "node", "root"))
        left, right = similar(data[:n], data[n:] or None)
        right = right + (n if len(data) > n else 0)
        links = spanning(zip(left.tolist(), right.tolist()), nodes, roots)
        return pa.table({c: pa.array([min(x) if c == "a" else max(x) for x in links], pa.int64()) for c in "ab"})

    rows = blocks.join(payload.select("node", "payload"), "node")
    return rows.groupBy("group", "a", "b").applyInArrow(run, "a long, b long")


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: DataFrame, similar: Callable[[list, list | None], tuple], small: int = 8, block: int = 512
) -> tuple[DataFrame, DataFrame]:
    """Components of the graph of similar nodes that share a bucket: (node, root), and the links used (a, b).

    Pairs of a bucket are not all made. First every node meets the smallest of its bucket, and ``verify`` keeps the pairs
    that are similar. A bucket whose nodes are one component by then is done. In the others, without that smallest node,
    all pairs of two components are still open: up to ``small`` nodes they are made, beyond that the nodes are put into
    blocks and two blocks at a time are compared in one task by ``similar``, on ``payload`` (node, payload); only links that
    join something leave the task. So no pair that could join two components stays unseen, and no task holds more than
    two blocks.
    """
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"))
    met = members.join(hubs, "bucket").where("node <> hub")
    links = checkpointed(verify(met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()).select("a", "b"))
    roots = checkpointed(components(links))
    left = met.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = left.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", "n")
    left = checkpointed(left.join(sizes, "bucket").select("bucket", "node", "root", "n"))
    few = left.where(F.col("n") <= small)
    one, other = (few.select("bucket", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    pairs = one.join(other, "bucket").where("a < b AND root_a <> root_b").select("a", "b").distinct()
    dense = left.where(F.col("n") > small)
    more = checkpointed(verify(pairs).select("a", "b").union(_compared(_blocks(dense, block), payload, similar).select("a", "b")))
    links = links.union(more)
    return checkpointed(components(links)), links
