"""Ordered computations per key that do not put a whole key into one task.

A plain ``Window.partitionBy(session).orderBy(id)`` sorts one session in one task. When a session may hold
a third of the log that task never finishes. Here every key is cut into *cells*: contiguous stretches of the
order (an id range, or a calendar hour). Windows run inside (key, cell), and the few per-cell totals are
scanned per key to give each cell its offset. The result equals the plain window exactly, as long as the
cell expression never decreases along the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

ID_CELL_ROWS = 1 << 20  # at most this many distinct ids share a cell


def id_cell(col: str | Column, rows: int = ID_CELL_ROWS) -> Column:
    """Cells for an order by a unique integer id: never more than ``rows`` rows each."""
    return F.floor((F.col(col) if isinstance(col, str) else col) / F.lit(rows))


def hour_cell(col: str | Column) -> Column:
    """Cells for an order by time."""
    return F.date_trunc("hour", col)


def cell_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    *,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add a running row number, inclusive running sums and previous-row values per key.

    ``rank`` names the 1-based row number; ``sums`` maps new column -> summed expression (nulls count as 0);
    ``lags`` maps new column -> expression read from the previous row.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    ks = list(keys)
    base = df.withColumn("_cell", cell)
    w = Window.partitionBy(*ks, "_cell").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base
    for name, expr in sums.items():
        local = local.withColumn(f"_v_{name}", F.coalesce(expr.cast("double" if _is_double(df, expr) else "long"), F.lit(0)))
    for name, expr in lags.items():
        local = local.withColumn(f"_l_{name}", F.struct(expr.alias("v")))
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    if lags:
        aggs.append(F.max_by(F.struct(*[F.col(f"_l_{n}") for n in lags]), F.struct(*order)).alias("_last"))
    wc = Window.partitionBy(*ks).orderBy("_cell")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    cells = local.groupBy(*ks, "_cell").agg(*aggs)
    cells = cells.select(
        *ks,
        "_cell",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.lag("_last").over(wc).alias("_prev")] if lags else []),
    )
    out = local
    if rank:
        out = out.withColumn("_r", F.row_number().over(w))
    for n in sums:
        out = out.withColumn(f"_s_{n}", F.sum(f"_v_{n}").over(run))
    for n in lags:
        out = out.withColumn(f"_p_{n}", F.lag(f"_l_{n}").over(w))
    out = out.join(cells, [*ks, "_cell"])
    if rank:
        out = out.withColumn(rank, (F.col("_r") + F.col("_o_n")).cast("long"))
    for n in sums:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.col(f"_o_{n}"))
    for n in lags:
        out = out.withColumn(n, F.coalesce(F.col(f"_p_{n}"), F.col(f"_prev._l_{n}"))["v"])
    keep = df.columns + ([rank] if rank else []) + list(sums) + list(lags)
    return out.select(*dict.fromkeys(keep))


def range_numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in its key, whatever the values of the order are.

    Rows are sorted into range partitions over (keys, order), written once, and counted in place; a key that spreads over
    several partitions gets the counts of the earlier ones added, at most one number per key and partition. Neither sparse
    ids nor one stamp for all rows makes a partition large, as cells by value would; only rows equal in keys and order stay together.
    Rows with a null key are dropped.
    """
    by = [*keys, *order]
    laid = df.dropna(subset=list(keys)).repartitionByRange(*by).sortWithinPartitions(*by)
    laid = checkpointed(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return laid.join(parts, [*keys, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def _is_double(df: DataFrame, expr: Column) -> bool:
    return df.select(expr.alias("x")).schema[0].dataType.simpleString() in ("double", "float")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Each task's rows are cut to n per key before the shuffle.

    Spark does that cut by itself up to n = 1000; beyond, rows are first ranked within 64 salts per key.
    """
    name = rank or "_rn"
    if n > 1000:
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        df = df.withColumn("_rs", F.row_number().over(salted)).where(F.col("_rs") <= n).drop("_rs", "_salt")
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, by order."""
    return top_per_key(df, keys, order, 1)


def join_ordered(values: str | Column, order: Sequence[str | Column], sep: str) -> Column:
    """Aggregate: join strings of a group in the given order."""
    v = F.col(values) if isinstance(values, str) else values
    packed = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], v.alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["v"]), sep)
