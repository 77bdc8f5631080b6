"""Exact and near-duplicate removal over 64-bit similarity hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import hamming64
from palimpsest.operators.components import components
from palimpsest.session import checkpointed

MAX_HAMMING = 3
FOLD_PAIRS = 1_000_000  # pairs of a component that one task settles
HOT_KEY = 2_000  # a band key shared by more hashes than this is refined
FIRST_TURN, TURN_GROWTH = 100_000, 8  # hashes settled first, and how much larger each later turn is


def dedupe_exact(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per content key. The winner is found with a map-side combine, so a hot key costs one row per task."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, key).where(F.struct(*order) == F.col("_first")).drop("_first")


def _cut(lo: int, bits: int, parts: int) -> list[tuple[int, int]]:
    """Cut ``bits`` positions starting at ``lo`` into ``parts`` runs of (start, width)."""
    base, extra = divmod(bits, parts)
    out = []
    for i in range(parts):
        width = base + (1 if i < extra else 0)
        out.append((lo, width))
        lo += width
    return out


def _first_keys(hashes: DataFrame, parts: int) -> DataFrame:
    """The columns of ``hashes`` with part, value, band and mask: a row for each run of bits of ``sim``, and the bits it agrees on."""
    runs = _cut(0, 64, parts)
    value = F.array(*[F.shiftrightunsigned("sim", lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in runs])
    mask = F.array(*[F.lit(_signed(((1 << n) - 1) << lo)) for lo, n in runs])
    rows = hashes.select(*hashes.columns, F.posexplode(value).alias("part", "value"))
    return rows.withColumn("band", F.xxhash64("part", "value")).withColumn("mask", F.get(mask, F.col("part")))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _refine(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of hot bands cut again: the bits that a band does not agree on yet are split into ``parts`` runs."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = batch.column("sim").to_numpy().view(np.uint64)
            masks = batch.column("mask").to_numpy().view(np.uint64)
            for mask in np.unique(masks).tolist():
                at = np.flatnonzero(masks == np.uint64(mask))
                free = [b for b in range(64) if not mask >> b & 1]
                for part, (lo, n) in enumerate(_cut(0, len(free), parts)):
                    value = np.zeros(len(at), np.uint64)
                    for k, b in enumerate(free[lo : lo + n]):
                        value |= (sim[at] >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
                    more = _signed(mask | sum(1 << b for b in free[lo : lo + n]))
                    kept = [batch.column(c).take(pa.array(at)) for c in names if c != "mask"]
                    new = [pa.array(np.full(len(at), more)), pa.array(np.full(len(at), part), pa.int32()), pa.array(value.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*kept, *new], names=[*[c for c in names if c != "mask"], "mask", "_part", "_value"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names if c != "mask"] + ["mask bigint", "_part int", "_value bigint"])
    out = rows.mapInArrow(run, schema)
    return out.withColumn("band", F.xxhash64("band", "_part", "_value")).select(*names)


def _refined(rows: DataFrame, max_hamming: int, hot: int) -> DataFrame:
    """Rows with their final bands. A band that more than ``hot`` hashes share is cut again and again until it is not, or until
    no bits are left to cut: hashes that agree on all but n bits are at most 2^n, so this ends."""
    parts = max_hamming + 1
    done = None
    while True:
        sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.min(F.bit_count("mask")).alias("bits"))
        hotter = checkpointed(sizes.where((F.col("n") > hot) & (F.col("bits") < 64 - parts)).select("band"))
        if hotter.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cool = rows.join(hotter, "band", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        rows = checkpointed(_refine(rows.join(hotter, "band", "left_semi"), parts))


def band_keys(hashes: DataFrame, max_hamming: int = MAX_HAMMING, hot: int = HOT_KEY) -> DataFrame:
    """Rows (sim, band) such that two hashes within ``max_hamming`` bits share at least one band.

    With d+1 runs of bits, at most d differing bits leave one run equal. A run value shared by more than ``hot``
    hashes would pair too many rows, so those hashes are cut again: the bits outside the runs already agreed on
    are split into d+1 runs, one of which must agree too. Each level keeps the guarantee, so no pair is lost.
    """
    rows = _first_keys(hashes.select("sim"), max_hamming + 1).select("sim", "band", "mask")
    return _refined(rows, max_hamming, hot).select("sim", "band")


def near_pairs(firsts: DataFrame, max_hamming: int = MAX_HAMMING, hot: int = HOT_KEY) -> DataFrame:
    """(sim, earlier): distinct hashes within ``max_hamming`` bits where ``earlier`` comes first in the order."""
    keys = band_keys(firsts, max_hamming, hot).join(firsts, "sim")
    a = keys.select("band", F.col("sim"), F.col("at").alias("at_a"))
    b = keys.select("band", F.col("sim").alias("earlier"), F.col("at").alias("at_b"))
    return a.join(b, "band").where((F.col("at_b") < F.col("at_a")) & (hamming64("sim", "earlier") <= max_hamming)).select("sim", "earlier").distinct()


def _settled(sim: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The hashes kept among those of whole components: one is kept unless an earlier kept one is near it."""
    nodes, at = np.unique(np.concatenate([earlier, sim]), return_inverse=True)
    before, after = at[: len(earlier)], at[len(earlier) :]
    later = after[np.argsort(before, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=len(nodes)))])
    left, gone = np.bincount(after, minlength=len(nodes)), np.zeros(len(nodes), bool)
    ready = np.flatnonzero(left == 0)  # all that come before them are settled
    while len(ready):
        counts = starts[ready + 1] - starts[ready]
        near = later[np.repeat(starts[ready] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        gone[near[np.repeat(~gone[ready], counts)]] = True
        np.subtract.at(left, near, 1)
        near = np.unique(near)
        ready = near[left[near] == 0]
    return nodes[~gone]


def _fold(labelled: DataFrame, flush: int = 100_000) -> DataFrame:
    """Kept hashes (sim) of pairs (sim, earlier, root); the pairs of a root meet in one task, a run of roots at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.empty((3, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("sim", "earlier", "root")]))
            n += batch.num_rows
            if n < flush:
                continue
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[2], rows[2, -1]))  # roots are in order; the last one may go on
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(_settled(rows[0, :cut], rows[1, :cut]))], names=["sim"])
            held, n = [rows[:, cut:]], len(rows[2]) - cut
        rows = np.concatenate(held, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(_settled(rows[0], rows[1]), pa.int64())], names=["sim"])

    return labelled.select("sim", "earlier", "root").repartition("root").sortWithinPartitions("root").mapInArrow(run, "sim long")


def _round(firsts: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pairs in large components: the hashes without an earlier neighbour, which are kept, and the pairs still open."""
    first = live.select(F.col("earlier").alias("sim")).distinct().join(live.select("sim").distinct(), "sim", "left_anti")
    dropped = live.join(first.select(F.col("sim").alias("earlier")), "earlier", "left_semi").select("sim").distinct()
    left = live.join(dropped, "sim", "left_anti").join(dropped.select(F.col("sim").alias("earlier")), "earlier", "left_anti").select("sim", "earlier")
    # a later hash that only dropped ones were near has no pair left: it is kept, too
    freed = live.select("sim").distinct().join(dropped, "sim", "left_anti").join(left.select("sim").distinct(), "sim", "left_anti")
    freed = freed.join(left.select(F.col("earlier").alias("sim")).distinct(), "sim", "left_anti")
    return checkpointed(first.unionByName(freed)), checkpointed(left)


def greedy_keep(firsts: DataFrame, pairs: DataFrame, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """Keep a hash unless an earlier kept one is near it.

    The pairs are split into connected components, whose decisions do not touch each other; each is settled in one pass
    through its pairs in one task, however long its chains are. Of a component of more than ``fold_pairs`` pairs the hashes
    that nothing comes before are settled first, with what they drop, until its rest falls apart or is small enough.
    """
    live = checkpointed(pairs)
    ends = live.select("sim").union(live.select("earlier")).distinct()
    out = firsts.select("sim").join(ends, "sim", "left_anti")
    while True:
        n = live.count()
        if n == 0:
            return out
        labelled = live.join(components(live.select(F.col("sim").alias("a"), F.col("earlier").alias("b"))).withColumnRenamed("node", "sim"), "sim")
        if n <= fold_pairs:
            return out.unionByName(_fold(labelled))
        big = checkpointed(labelled.groupBy("root").count().where(F.col("count") > fold_pairs).select("root"))
        out = out.unionByName(checkpointed(_fold(labelled.join(big, "root", "left_anti"))))
        kept, live = _round(firsts, labelled.join(big, "root", "left_semi").select("sim", "earlier"))
        out = out.unionByName(kept)


def _turns(firsts: DataFrame, first: int, grow: int) -> list[DataFrame]:
    """``firsts`` (sim, at) in turns that follow each other in the order, each ``grow`` times as large; rows of one place in the order share a
    turn. As many counts as there are stretches of ``first`` rows pass the driver."""
    n = firsts.count()
    if n <= first * 2:
        return [firsts]
    laid = checkpointed(firsts.repartitionByRange(-(-n // first), "at").withColumn("_part", F.spark_partition_id()))
    out, low, seen, most = [], 0, 0, first
    counts = sorted(laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    for i, (part, size) in enumerate(counts):
        seen += size
        if seen >= most or i == len(counts) - 1:
            out.append(laid.where(F.col("_part").between(low, part)).drop("_part"))
            low, seen, most = part + 1, 0, most * grow
    return out


def dedupe_near(
    df: DataFrame, order: Sequence[str], sim: str = "sim", max_hamming: int = MAX_HAMMING, hot: int = HOT_KEY, first: int = FIRST_TURN, grow: int = TURN_GROWTH
) -> DataFrame:
    """Ordered greedy removal: drop a row if an earlier kept row is within ``max_hamming`` bits.

    Rows with one hash share every neighbour, so only the first of them can survive; the search then runs over distinct
    hashes, in turns of the order: what is near a hash kept in an earlier turn goes before the pairs of its own turn are
    made. So a dense group is paired with the few kept of it, not with itself.
    """
    firsts = checkpointed(df.groupBy(F.col(sim).alias("sim")).agg(F.min(F.struct(*order)).alias("at")))
    keep = None
    for turn in _turns(firsts, first, grow):
        if keep is not None:
            turn = checkpointed(drop_known(turn, keep, max_hamming=max_hamming, hot=hot))
        kept = greedy_keep(turn, near_pairs(turn, max_hamming, hot)).select("sim")
        keep = checkpointed(kept) if keep is None else keep.unionByName(checkpointed(kept))
    named = keep.join(firsts, "sim").select(F.col("sim").alias("_s"), F.col("at").alias("_at"))
    return df.join(named, (F.col(sim) == F.col("_s")) & (F.struct(*order) == F.col("_at")), "left_semi")


def near_known(new: DataFrame, known: DataFrame, max_hamming: int = MAX_HAMMING, hot: int = HOT_KEY) -> DataFrame:
    """(sim): hashes of ``new`` (sim) near one of ``known`` (sim, part, value: its first keys, as many as share one with a new hash).

    New hashes meet known ones only; known ones never meet each other.
    """
    mine = _first_keys(new.select("sim").distinct(), max_hamming + 1)
    there = known.select("sim", "part", "value").distinct().withColumn("band", F.xxhash64("part", "value"))
    there = there.join(mine.select("band").distinct(), "band", "left_semi").join(mine.select("band", "mask").distinct(), "band")
    rows = mine.select("sim", "band", "mask", F.lit(False).alias("old")).unionByName(there.select("sim", "band", "mask", F.lit(True).alias("old")))
    rows = _refined(checkpointed(rows), max_hamming, hot)
    old = rows.where("old").select("band", F.col("sim").alias("known"))
    met = rows.where("NOT old").select("band", "sim").join(old, "band")
    return met.where(hamming64("sim", "known") <= max_hamming).select("sim").distinct()


def drop_known(df: DataFrame, stored: DataFrame, sim: str = "sim", max_hamming: int = MAX_HAMMING, hot: int = HOT_KEY) -> DataFrame:
    """Drop rows whose hash is within ``max_hamming`` bits of a stored one (sim)."""
    known = _first_keys(stored.select("sim").distinct(), max_hamming + 1)
    near = near_known(df.select(F.col(sim).alias("sim")), known, max_hamming, hot)
    return df.join(near.withColumnRenamed("sim", sim), sim, "left_anti")


# --- a stored index of first keys --------------------------------------------------------------------------
PREFIXES = 64  # folders for each run of bits


def _prefixed(keys: DataFrame) -> DataFrame:
    """Keys with the folder they belong to: the run of bits and its value's remainder."""
    return keys.select("sim", "part", "value", (F.col("part") * PREFIXES + F.pmod("value", F.lit(PREFIXES))).cast("int").alias("prefix"))


def write_bands(hashes: DataFrame, path: str, max_hamming: int = MAX_HAMMING) -> None:
    """Store the first keys of ``hashes`` (sim) in a folder for each prefix, ordered by value."""
    keys = _prefixed(_first_keys(hashes.select("sim").distinct(), max_hamming + 1))
    keys.repartition("prefix").sortWithinPartitions("prefix", "value").write.mode("overwrite").partitionBy("prefix").parquet(path)


def touched_bands(index: DataFrame, hashes: DataFrame, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """The keys of a stored index that could share one with ``hashes`` (sim): other folders are not read. The folders' numbers,
    at most ``PREFIXES`` for each run of bits, pass the driver."""
    keys = _prefixed(_first_keys(hashes.select("sim").distinct(), max_hamming + 1))
    wanted = sorted(r["prefix"] for r in keys.select("prefix").distinct().collect())
    return index.where(F.col("prefix").isin(wanted)).select("sim", "part", "value")
