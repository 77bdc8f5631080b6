"""Keyed merges: plain Parquet has no MERGE, so a merge yields the new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Insert or overwrite by key; the row of the batch that is last in ``order`` wins; ``keep`` columns stay as stored.

    Rows that tie in ``order`` are settled by their values, so the outcome does not depend on how the batch is read.
    """
    cols = [c for c in target.columns if c not in keys]
    value = F.struct(*[F.col(c) for c in cols])
    last = batch.groupBy(*keys).agg(F.max_by(value, F.struct(*order, *[c for c in cols if c not in order])).alias("_v"))
    old = target.select(*keys, F.struct(*cols).alias("_o"))
    both = old.join(last, list(keys), "full_outer")

    def pick(c):
        new, was = F.col(f"_v.{c}"), F.col(f"_o.{c}")
        if c in keep:
            return F.when(F.col("_o").isNotNull(), was).otherwise(new).alias(c)
        return F.when(F.col("_v").isNotNull(), new).otherwise(was).alias(c)

    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_v").isNotNull(), "updated").otherwise("kept").alias("action")
    return both.select(*keys, *[pick(c) for c in cols], action)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a merged snapshot to a fresh folder; moving a pointer to it is the caller's matter."""
    df.drop("action").write.mode("errorifexists").parquet(path)
