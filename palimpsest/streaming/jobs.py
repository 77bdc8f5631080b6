"""Streaming twins of the incremental operators. Each function takes and returns streaming DataFrames, or writes
through ``foreachBatch`` with ids that make a repeated batch harmless."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palimpsest.functions import rules as R
from palimpsest.functions import text as X
from palimpsest.operators import graph as G
from palimpsest.operators import neardup as N
from palimpsest.operators.chunks import CHUNK_SIZE, GAP_MINUTES, OVERLAP, _chunk_ends, timed_sentences
from palimpsest.plans.kg_build import kg_build
from palimpsest.session import ensure_checkpoint_dir
from palimpsest.sources.messages import with_hash


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoints: every executor reaches it."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str, schema, files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A growing Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> str:
    """Process what is there, appending to Parquet; started again with the same folders it goes on from its mark."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint or out + "-marks").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_messages(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """User and assistant rows with a watermark on their time; the query's checkpoint is the high-water mark."""
    return log.where(F.col("role").isin("user", "assistant") & ~F.col("is_summary")).withWatermark("ts", delay)


def stream_dedupe(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop repeats of (session, role, hash). With ``delay`` only those that arrive within the watermark, for less state."""
    key = ["session_id", "role", "content_hash"]
    return with_hash(log).withWatermark("ts", delay).dropDuplicatesWithinWatermark(key) if delay else with_hash(log).dropDuplicates(key)


def stream_groups(log: DataFrame, gap_minutes: int = 5, delay: str = "0 seconds") -> DataFrame:
    """Groups of rows less than ``gap_minutes`` apart, per session, emitted once closed. The gap counts from the previous
    row; the stamp rule proper (from the last stamped row) is ``history.group_stamps``."""
    # session windows also join rows exactly one gap apart, so the gap is a microsecond short
    w = F.session_window("ts", f"{gap_minutes * 60_000_000 - 1} microseconds")
    out = log.withWatermark("ts", delay).groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("session_id", F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 0.000001 SECOND")).alias("end"), "n")


def stream_turn_trigger(log: DataFrame, interval: int = 50) -> DataFrame:
    """Every ``interval``-th assistant row of a session. The state is one count; a micro-batch is counted in id order."""

    def count(key, pdfs, state):
        seen = state.get[0] if state.exists else 0
        ids = np.sort(np.concatenate([p["id"].to_numpy() for p in pdfs]))
        turns = seen + np.arange(1, len(ids) + 1)
        state.update((int(seen + len(ids)),))
        hit = turns % interval == 0
        yield pd.DataFrame({"session_id": key[0], "id": ids[hit], "turn_no": turns[hit]})

    rows = log.where("role = 'assistant' AND NOT is_summary").select("session_id", "id")
    return rows.groupBy("session_id").applyInPandasWithState(count, "session_id string, id long, turn_no long", "seen long", "append", GroupStateTimeout.NoTimeout)


_CHUNK = "session_id string, chunk_ord long, start_ts timestamp, chars long, raw_text string"


def stream_chunks(log: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, gap_minutes: int = GAP_MINUTES, delay: str = "0 seconds", idle_minutes: int = 5) -> DataFrame:
    """Sliding chunks with carry-over. Sentences wait until the watermark has passed them (so late rows still
    fall into place); chunks that cannot grow are emitted. A session idle for ``idle_minutes`` shows its tail, which stays in
    the state: if the session goes on, the chunk comes again under its number. ``latest_chunks`` keeps the last of each."""
    sents = timed_sentences(log.withWatermark("ts", delay)).withColumn("stamp", X.stamp_long("ts"))

    def step(key, pdfs, state):
        number, rows, mark = (state.get[0], json.loads(state.get[1]), state.get[2]) if state.exists else (0, [], 0)
        for p in pdfs:
            micros = p["ts"].astype("int64").to_numpy() // {"ns": 1000, "us": 1}[np.datetime_data(p["ts"].dtype)[0]] if len(p) else []
            rows += [[int(t), int(i), int(q), s, st] for t, i, q, s, st in zip(micros, p["id"], p["pos"], p["text"], p["stamp"])]
        rows.sort(key=lambda r: r[:3])
        closing = state.hasTimedOut
        passed = state.getCurrentWatermarkMs() * 1000
        ready = len(rows) if closing else sum(r[0] < passed for r in rows)
        out, i = [], 0
        if ready:
            ends, nexts = _chunk_ends(np.array([len(r[3]) for r in rows[:ready]]), size, overlap)
            while i < ready:
                j = int(ends[i])
                if j >= ready and not closing:
                    break
                part = rows[i:j]
                late = [k == 0 or part[k][0] - part[k - 1][0] >= gap_minutes * 60_000_000 for k in range(len(part))]
                text = "\n".join(f"{r[4]} {r[3]}" if up else r[3] for r, up in zip(part, late))
                out.append((key[0], number, pd.Timestamp(part[0][0], unit="us"), sum(len(r[3]) for r in part), text))
                if j >= ready:
                    break  # the open tail
                number += 1
                i = int(nexts[i])
        rows = rows[i:]
        mark = max([mark, *[r[0] for r in rows]])
        state.update((number, json.dumps(rows), mark))
        if not closing:
            state.setTimeoutTimestamp(max(mark // 1000 + idle_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "chunk_ord", "start_ts", "chars", "raw_text"])

    cols = sents.select("session_id", "ts", "id", "pos", "text", "stamp")
    return cols.groupBy("session_id").applyInPandasWithState(step, _CHUNK, "number long, rows string, mark long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Of the chunks shown under one number the longest: a tail only grows."""
    rest = [c for c in chunks.columns if c not in ("session_id", "chunk_ord")]
    grown = chunks.groupBy("session_id", "chunk_ord").agg(F.max_by(F.struct(*rest), "chars").alias("v"))
    return grown.select("session_id", "chunk_ord", "v.*").select(*chunks.columns)


def near_dup_writer(store: str, sim: str = "sim", order: tuple[str, ...] = ("id",)):
    """foreachBatch writer: drop records near a stored one or an earlier one of the batch, store the rest.

    Each batch has its own folder, so a retried batch replaces itself; it reads only the folders before it. Beside the
    records their hashes are stored by runs of bits: a batch reads those folders of the index that its own hashes touch,
    and only its hashes are joined with them.
    """
    bands = f"{store.rstrip('/')}-bands"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = batch
        if epoch > 0:
            hashes = batch.select(F.col(sim).alias("sim"))
            index = spark.read.schema("sim long, part int, value long, epoch long, prefix int").parquet(bands).where(F.col("epoch") < epoch)
            near = N.near_known(hashes, N.touched_bands(index, hashes))
            kept = kept.join(near.withColumnRenamed("sim", sim), sim, "left_anti")
        N.dedupe_near(kept, list(order), sim).write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        N.write_bands(spark.read.parquet(f"{store}/epoch={epoch}").select(F.col(sim).alias("sim")), f"{bands}/epoch={epoch}")

    return write


def stream_detect(log: DataFrame, catalog: list[dict] | None = None) -> DataFrame:
    """Detections as rows arrive: a projection, no state."""
    return log.withColumn("det", R.detect("content", None, catalog))


def kg_writer(aliases_of: Callable[[SparkSession], DataFrame], store: str):
    """foreachBatch writer: build the graph rows of a batch into folders of its epoch.

    New aliases of earlier epochs are resolved against, so later batches link to nodes made before. The aliases that the stream
    begins with are indexed once, by its first batch, and each batch's new ones when it is done; a batch then reads the
    parts of the index that its own terms touch.
    """
    index = f"{store.rstrip('/')}-index"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0:
            G.write_alias_index(aliases_of(spark).select(*G.ALIAS_COLUMNS), f"{index}/epoch=-1")
        kinds = "id string, node_id string, alias string, source string, weight double, alias_key string, post long, whole boolean, epoch long, prefix int"
        before = spark.read.schema(kinds).parquet(index).where(F.col("epoch") < epoch)
        out = kg_build(batch, lambda terms: G.touched_aliases(before, terms, best=True))
        for name in ("nodes", "aliases", "evidence", "edges"):
            out[name].write.mode("overwrite").parquet(f"{store}/{name}/epoch={epoch}")
        made = spark.read.parquet(f"{store}/aliases/epoch={epoch}")
        G.write_alias_index(made.select(*G.ALIAS_COLUMNS), f"{index}/epoch={epoch}")

    return write


def stream_need_summary(log: DataFrame) -> DataFrame:
    """Running totals per session for the summary rule, in update mode; apply ``summary_due`` to a row and a time."""
    s = F.col("is_summary")
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~s).alias("plain"), F.max(F.when(s, F.col("ts"))).alias("last_ts"))


def summary_due(totals: DataFrame, now, window_rows: int = 100, min_turns: int = 40, min_minutes: int = 30) -> DataFrame:
    age = F.floor((F.unix_micros(now) - F.unix_micros("last_ts")) / 60_000_000)
    due = (F.col("total") >= window_rows) & (F.col("last_ts").isNull() | (age >= min_minutes)) & (F.col("plain") >= min_turns)
    return totals.withColumn("due", F.coalesce(due, F.lit(False)))


def latest_writer(store: str):
    """foreachBatch writer for update mode: each epoch's changed rows in their own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{store}/epoch_no={epoch}")

    return write


def latest_rows(spark: SparkSession, store: str, key: str) -> DataFrame:
    """Newest row per key over all epochs."""
    rows = spark.read.parquet(store)
    cols = [c for c in rows.columns if c not in (key, "epoch_no", "epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select(key, "r.*")
