"""Detection over tables of texts, and the quality gates on entity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import rules as R


def detect_texts(df: DataFrame, text: str = "content", response: str | None = None, catalog: list[dict] | None = None, suffix: str = "") -> DataFrame:
    """Add a ``det`` column; a large input is not shuffled."""
    return df.withColumn("det", R.detect(text, F.col(response) if response else None, catalog, suffix))


def entity_rows(df: DataFrame, entities, keep: list[str]) -> DataFrame:
    """One row per entity with its position."""
    return df.select(*keep, F.posexplode(entities).alias("pos", "e")).select(*keep, "pos", "e.*")


def det_v2_gates(rows: DataFrame, key: str = "msg_id", text: str = "source_text") -> DataFrame:
    """Quality gates on entity rows (key, source text, type, norm, start, end, score).

    Task and Project need two words unless quoted; calendar and generic words are no names; overlapping spans of
    one type are merged to the best score. Windows cover the entities of one message.
    """
    name = F.col("type").isin("Task", "Project")
    quoted = F.lit(False)
    for a, b in [("'", "'"), ('"', '"'), ("“", "”"), ("‘", "’")]:
        quoted = quoted | F.col(text).contains(F.concat(F.lit(a), F.col("norm"), F.lit(b)))
    many = F.regexp_like(F.trim("norm"), F.lit(r"(?U)\S\s+\S"))
    plain = F.lower(F.trim("norm")).isin(R.NOT_NAMES)
    rows = rows.where(~name | many | quoted).where(~(name & plain)).where(F.col("score") >= R.MIN_ENTITY_SCORE)
    w = Window.partitionBy(key, "type").orderBy("start", "end", "pos")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.coalesce(F.col("start") < reach, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(key, "type", "island").orderBy(F.desc("score"), "start", "pos")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_new", "island", "_k")


def det_v2_slots(rows: DataFrame, key: str = "msg_id", text: str = "source_text") -> DataFrame:
    """Slots derived from entity rows with an ``attrs`` map: deadline, date, time_range, priority."""
    first = lambda cond, v: F.min(F.when(cond, F.struct("pos", v.alias("v"))))["v"]
    iso, grain, span = F.col("attrs")["iso"], F.col("attrs")["grain"], F.col("attrs")["range"]
    time = F.col("type") == "Time"
    by = F.regexp_like(F.col(text), F.lit(r"(?i)\bby\b"))
    low = F.lower(F.col(text))
    said = lambda w: F.regexp_like(low, F.lit(rf"\b{w}\b"))
    priority = F.when(said("urgent"), "high").when(said("med"), "med").when(said("high"), "high").when(said("low"), "low")
    return rows.groupBy(key).agg(
        first(time & iso.isNotNull() & by, iso).alias("deadline"),
        first(time & (grain == "day"), iso).alias("date"),
        first(time & span.isNotNull(), span).alias("time_range"),
        F.max(priority).alias("priority"),
    )
