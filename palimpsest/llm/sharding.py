"""Sharding by best-fit decreasing: indivisible groups of equal texts enter the bin that they fill best.

Groups of at least ``1 / per_bin`` of a bin are packed one by one; there are at most ``bins * per_bin`` of them. The others
are gathered by hash into ``cells`` items, CELLS_PER_BIN for each bin at least. A cell above a given capacity is taken apart
into its groups. So the packing, in the driver, sees a number of items that grows with the bins, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

PER_BIN = 1024
CELLS = 8192
CELLS_PER_BIN = 16
SLOT_CELLS = 1024


class Tree:
    """A balanced search tree (AA tree) over (room, bin): add, remove, and the least key not below a given one."""

    def __init__(self):
        self.root = None  # a node: [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = cut(t[2], key)
            elif key > t[0]:
                t[3] = cut(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            else:
                side = 3 if t[2] is None else 2
                near = t[side]
                while near[5 - side]:
                    near = near[5 - side]
                t[0] = near[0]
                t[side] = cut(t[side], near[0])
            level = 1 + min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0)
            if level < t[1]:
                t[1] = level
                if t[3] and t[3][1] > level:
                    t[3][1] = level
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def least(self, key):
        """The smallest key not below ``key``, or None."""
        t, best = self.root, None
        while t:
            if t[0] >= key:
                t, best = t[2], t[0]
            else:
                t = t[3]
        return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, largest first, each into the tightest bin with room; a size above the capacity has its own."""
    tree, bins, n = Tree(), [0] * len(sizes), 0
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        spot = tree.least((sizes[at], -1))
        if spot is None:
            spot = (max(capacity, sizes[at]), n)
            n += 1
        else:
            tree.remove(spot)
        bins[at] = spot[1]
        if spot[0] > sizes[at]:
            tree.add((spot[0] - sizes[at], spot[1]))
    return bins


def tightest(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity found by halving with which best fit needs no more than ``shards`` bins, and the bins."""
    low = max([-(-sum(sizes) // shards), 1])
    high = low + max(sizes, default=0)
    best = None
    while low < high:
        mid = (low + high) // 2
        bins = best_fit(sizes, mid)
        if max(bins, default=0) < shards:
            high, best = mid, (mid, bins)
        else:
            low = mid + 1
    return best if best and best[0] == high else (high, best_fit(sizes, high))


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, per_bin: int = PER_BIN, cells: int = CELLS, slot_cells: int = SLOT_CELLS) -> DataFrame:
    """One row per document: size, text_crc32, shard, and slot, its gapless number in the shard.

    With ``shards`` the least capacity is sought that best fit meets with that many bins (sizes near equal); with
    ``capacity`` the number of bins is what best fit needs. ``docs`` needs doc_id and text; other columns are ignored. Size is
    the text's UTF-8 bytes plus 1; a null text has no bytes and groups with other nulls. Equal texts share a shard, and so do,
    harmlessly, texts of equal 64-bit hash. Every row counts, repeated rows and null ids included; an empty table gives no
    rows. One group above a bin's share fills a bin of its own.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = shards if capacity is None else -(-total // capacity)
    least = max(1, total // max(1, bins * per_bin))
    cells = max(cells, CELLS_PER_BIN * bins)
    cell, alone = F.pmod(F.xxhash64("group"), F.lit(cells)), F.col("size") >= least
    if capacity is not None:
        full = groups.where(~alone).groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")).where(F.col("size") > capacity).select("cell").collect()
        alone = alone | cell.isin([r["cell"] for r in full])
    item = F.struct(alone.alias("alone"), F.when(alone, F.col("group")).otherwise(cell).alias("key"))
    # at most bins * per_bin + cells rows reach the driver, and the groups of cells above the capacity
    items = groups.groupBy(item.alias("item")).agg(F.sum("size").alias("size")).select("item.*", "size").orderBy("alone", "key").collect()
    sizes = [r["size"] for r in items]
    placed = best_fit(sizes, capacity) if capacity else tightest(sizes, shards)[1]
    spark = docs.sparkSession
    where = [(r["alone"], r["key"], b) for r, b in zip(items, placed)]
    alone = spark.createDataFrame([(k, b) for a, k, b in where if a], "group long, own int")
    rest = spark.createDataFrame([(k, b) for a, k, b in where if not a], "cell long, shared int")
    rows = (
        rows.join(F.broadcast(alone), "group", "left")
        .withColumn("cell", cell)
        .join(F.broadcast(rest), "cell", "left")
        .select("doc_id", "size", "text_crc32", "row", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(slot_cells)).cast("int").alias("part"))
    )
    # numbers in a shard: counts of its parts before, plus the number in the part
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (
        rows.withColumn("number", number)
        .join(counts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))
    )
