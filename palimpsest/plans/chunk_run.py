"""Log -> chunks -> duplicates removed -> records, with a high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import chunks as C
from palimpsest.operators import neardup as N
from palimpsest.session import checkpointed


def chunk_run(messages: DataFrame, since=None, inclusive: bool = False, hash: str = "blake2b", max_hamming: int = 3, **kw) -> DataFrame:
    """Records to store for the messages after ``since`` (a timestamp literal), near-duplicates removed."""
    rows = messages.where(F.col("role").isin("user", "assistant"))
    if since is not None:
        mark = F.lit(since).cast("timestamp")
        rows = rows.where(F.col("ts") >= mark if inclusive else F.col("ts") > mark)
    records = checkpointed(C.chunk_records(C.slide_chunks(C.timed_sentences(rows), **kw), hash=hash))
    order = ["start_ts", "session_id", "chunk_ord"]
    return N.dedupe_near(N.dedupe_exact(records, "hash", order), order, max_hamming=max_hamming)


def chunk_inventory(kept: DataFrame) -> DataFrame:
    """Per session: chunks kept, their average length, first and last start."""
    return kept.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.avg("len"), 6).alias("avg_len"),
        F.min("start_iso").alias("first_start"),
        F.max("start_iso").alias("last_start"),
    )


def dry_run_report(records: DataFrame) -> DataFrame:
    """Counts a dry run would print, nothing written."""
    return records.agg(F.count(F.lit(1)).alias("upserts"), F.count_distinct("session_id").alias("sessions"), F.sum("len").alias("chars"))
