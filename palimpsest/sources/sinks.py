"""Keyed sinks for chunk records, graph rows and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import det_id
from palimpsest.operators.merge import upsert
from palimpsest.operators.ordered import first_per_key


def one_of_each(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The first row of each key by ``order``, or by all other columns: a repeated key gives the same row on every run."""
    return first_per_key(rows, [key], order or [c for c, kind in rows.dtypes if c != key and "map<" not in kind] or [key])


def merge_chunks(stored: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Chunk records after an upsert by id."""
    return upsert(stored, batch, ["id"], order)


def chunk_sink(path_of_batch, path_of_store: str | None = None):
    """A foreachBatch writer: each micro-batch goes to its own folder, so a retried batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        one_of_each(batch, "id").write.mode("overwrite").parquet(path_of_batch(epoch))

    return write


def merge_edges(stored: DataFrame, batch: DataFrame, order: list[str], default_weight: float = 0.7) -> DataFrame:
    """Edges after insert-or-update on (src, dst, type); a stored edge keeps its id."""
    new = batch.withColumn("weight", F.coalesce("weight", F.lit(default_weight)))
    if "id" not in new.columns:
        new = new.withColumn("id", det_id("e_", "src_id", "dst_id", "type"))
    return upsert(stored, new.select(*stored.columns, *[c for c in order if c not in stored.columns]), ["src_id", "dst_id", "type"], order, keep=["id"])


def append_rows(stored: DataFrame, batch: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Append rows whose key is new, of a repeated key the first by ``order``; deterministic keys make a retry harmless."""
    fresh = one_of_each(batch.join(stored.select(key), key, "left_anti"), key, order)
    return stored.unionByName(fresh.select(*stored.columns))


def turn_rows(pairs: DataFrame, detection: Column, ts_assistant: bool = True) -> DataFrame:
    """Turn rows for storage: intent, score, entities and slots as JSON beside the two message ids."""
    d = detection
    return pairs.select(
        det_id("t_", "session_id", "user_msg_id").alias("id"),
        F.col("session_id").alias("sid"),
        "user_msg_id",
        "assistant_msg_id",
        "ts_user",
        *(["ts_assistant"] if ts_assistant else []),
        d["intent"]["label"].alias("intent"),
        F.to_json(F.struct(d["intent"]["score"].alias("intent"))).alias("scores_json"),
        F.to_json(d["entities"]).alias("detections_json"),
        F.to_json(d["slots"]).alias("slots_json"),
        d["detector_version"].alias("detector_version"),
        F.lit(False).alias("processed"),
    )
