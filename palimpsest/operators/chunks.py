"""Messages -> sentences -> overlapping chunks -> chunk records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.functions import text as X
from palimpsest.operators.ordered import range_numbered
from palimpsest.session import checkpointed

CHUNK_SIZE, OVERLAP, GAP_MINUTES = 200, 50, 5
BLOCK_SENTENCES = 20_000  # sentences of one session handled by one task


def timed_sentences(messages: DataFrame, roles: dict[str, str] | None = None, user_only: bool = True) -> DataFrame:
    """Sanitised, role-prefixed sentences with the time of their message; numbered per session."""
    rows = messages.where(F.col("role").isin("user", "assistant")) if user_only else messages
    parts = X.split_sentences(X.pre_sanitize(X.trim_ws("content")))
    sents = rows.select("session_id", "id", "ts", X.role_display("role", roles).alias("role"), F.posexplode(parts).alias("pos", "sentence"))
    return sents.select(
        "session_id", "id", "ts", "pos", "role", F.concat_ws(": ", "role", "sentence").alias("text")
    ).withColumn("len", F.length("text"))


def number_sentences(sents: DataFrame) -> DataFrame:
    """``n`` = position in the session, 0-based, by (ts, id, pos)."""
    return range_numbered(sents, ["session_id"], ["ts", "id", "pos"], "n")


def _chunk_ends(lens: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start: where a chunk begun there ends, and where the next one starts."""
    total = np.concatenate([[0], np.cumsum(lens)])
    starts = np.arange(len(lens))
    # last end whose summed length still fits; a first sentence always fits
    ends = np.maximum(np.searchsorted(total, total[:-1] + size, side="right") - 1, starts + 1)
    back = np.searchsorted(total, total[ends] - overlap, side="right") - 1
    return ends, np.maximum(np.minimum(back, ends), starts + 1)


def _blocked(numbered: DataFrame, size: int, block: int) -> DataFrame:
    """Copy the head of each block to the block before it, so chunks may reach over the border."""
    halo = size + 2  # a chunk holds at most ``size`` one-character sentences, and one more ends it
    if block < halo:
        raise ValueError(f"block must hold at least {halo} sentences")
    home = F.floor(F.col("n") / block)
    near = (F.col("n") % block < halo) & (home > 0)
    return numbered.withColumn("block", F.explode(F.when(near, F.array(home, home - 1)).otherwise(F.array(home))))


def _block_maps(size: int, overlap: int, block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        base = int(pdf["block"].iloc[0]) * block
        ends, nexts = _chunk_ends(pdf["len"].to_numpy(), size, overlap)
        own, n = min(block, len(pdf)), len(pdf)
        done = ends >= n
        # walk back from the last own start: where an orbit leaves the block, and after how many chunks
        exit_at, count = np.zeros(own, np.int64), np.zeros(own, np.int64)
        for i in range(own - 1, -1, -1):
            if done[i]:
                exit_at[i], count[i] = -1, 1
            elif nexts[i] >= block:
                exit_at[i], count[i] = nexts[i] - block, 1
            else:
                exit_at[i], count[i] = exit_at[nexts[i]], count[nexts[i]] + 1
        heads = min(own, size + 2)
        return pd.DataFrame(
            {"session_id": pdf["session_id"].iloc[0], "block": base // block, "entry": np.arange(heads), "exit": exit_at[:heads], "chunks": count[:heads]}
        )

    return run


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow one stretch of blocks from every entry: compose the maps and note each block's entry."""
    pdf = pdf.sort_values(["block", "entry"])
    out = []
    blocks = {b: (g["exit"].to_numpy(), g["chunks"].to_numpy()) for b, g in pdf.groupby("block", sort=True)}
    first = min(blocks)
    heads = len(blocks[first][0])
    at, count = np.arange(heads), np.zeros(heads, np.int64)
    for b in sorted(blocks):
        out.append(pd.DataFrame({"block": b, "start": np.arange(heads), "entry": at.copy(), "before": count.copy()}))
        exits, chunks = blocks[b]
        live = (at >= 0) & (at < len(exits))
        safe = np.where(live, at, 0)
        count = count + np.where(live, chunks[safe], 0)
        at = np.where(live, exits[safe], -1)
    ends = pd.DataFrame({"block": -1, "start": np.arange(heads), "entry": at, "before": count})
    res = pd.concat([*out, ends])
    res["session_id"], res["stretch"] = pdf["session_id"].iloc[0], int(pdf["stretch"].iloc[0])
    return res[["session_id", "stretch", "block", "start", "entry", "before"]]


_FOLLOW_SCHEMA = "session_id string, stretch long, block long, start long, entry long, before long"


def _block_entries(maps: DataFrame, fan: int = 1000) -> DataFrame:
    """Entry sentence and number of earlier chunks for each block, composing maps ``fan`` blocks at a time."""
    last = maps.agg(F.max("block")).first()[0]
    if last is None or last == 0:
        return maps.where("entry = 0 AND block = 0").select("session_id", "block", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    steps = maps.withColumn("stretch", F.floor(F.col("block") / fan)).groupBy("session_id", "stretch").applyInPandas(_follow, _FOLLOW_SCHEMA)
    steps = checkpointed(steps)
    whole = steps.where("block = -1").select(
        "session_id", F.col("stretch").alias("block"), F.col("start").alias("entry"), F.col("entry").alias("exit"), F.col("before").alias("chunks")
    )
    upper = _block_entries(whole, fan).select("session_id", F.col("block").alias("stretch"), F.col("at").alias("start"), F.col("before").alias("base"))
    return (
        steps.where("block >= 0")
        .join(upper, ["session_id", "stretch", "start"])
        .where("entry >= 0")
        .select("session_id", "block", F.col("entry").alias("at"), (F.col("before") + F.col("base")).alias("before"))
    )


def slide_chunks(
    sents: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, gap_minutes: int = GAP_MINUTES, block: int = BLOCK_SENTENCES
) -> DataFrame:
    """Pack sentences greedily to ``size`` characters, then step back at least ``overlap`` characters.

    Per session, in order (ts, id, pos). A session is cut into blocks of ``block`` sentences: each block first
    maps every possible entry sentence to the sentence where its chain of chunks leaves the block; composing
    the maps gives every block its entry, and all blocks are then chunked in parallel.
    """
    numbered = number_sentences(sents)
    blocks = _blocked(numbered, size, block)
    out_schema = "session_id string, chunk_ord long, start_ts timestamp, first long, last long, chars long, raw_text string"
    # a session of one block is entered at its first sentence; only the others need maps
    several = numbered.where(F.col("n") == block).select("session_id", F.lit(True).alias("several"))
    lens = blocks.select("session_id", "block", "n", "len").join(several, "session_id", "left_semi")
    # read twice: to see how many blocks there are, and to compose them
    maps = checkpointed(
        lens.groupBy("session_id", "block").applyInPandas(_block_maps(size, overlap, block), "session_id string, block long, entry long, exit long, chunks long")
    )
    pieces = blocks.join(several, "session_id", "left").join(_block_entries(maps), ["session_id", "block"], "left").where("several IS NULL OR at IS NOT NULL")
    pieces = pieces.fillna(0, ["at", "before"])
    stamped = pieces.select("session_id", "block", "at", "before", "n", "ts", "len", "text", X.stamp_long("ts").alias("stamp"))

    def cut(pdf: pd.DataFrame) -> list[tuple]:
        """Chunks that begin in one block; its rows are in order."""
        lens, ts = pdf["len"].to_numpy(), pdf["ts"].to_numpy()
        ends, nexts = _chunk_ends(lens, size, overlap)
        texts, stamps = pdf["text"].to_numpy(), pdf["stamp"].to_numpy()
        total = np.concatenate([[0], np.cumsum(lens)])
        late = np.concatenate([[True], np.diff(ts) >= np.timedelta64(gap_minutes, "m")])
        base, sid, number = int(pdf["block"].iloc[0]) * block, pdf["session_id"].iloc[0], int(pdf["before"].iloc[0])
        rows, i, n = [], int(pdf["at"].iloc[0]), len(pdf)
        while i < min(n, block):
            j = int(ends[i])
            lines = [f"{stamps[k]} {texts[k]}" if k == i or late[k] else texts[k] for k in range(i, j)]
            rows.append((sid, number, ts[i], base + i, base + j - 1, int(total[j] - total[i]), "\n".join(lines)))
            number += 1
            if j >= n:
                break
            i = int(nexts[i])
        return rows

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks lie one after the other; the last one of a batch waits for the next batch, so one block at most is held."""
        columns = ["session_id", "chunk_ord", "start_ts", "first", "last", "chars", "raw_text"]
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            key = list(zip(pdf["session_id"], pdf["block"]))
            starts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
            if held and (held[0]["session_id"].iloc[0], held[0]["block"].iloc[0]) != key[0]:
                starts.insert(0, 0)
            rows: list[tuple] = []
            for i, start in enumerate(starts):
                head = pdf.iloc[starts[i - 1] if i else 0 : start]
                whole = [*held, head] if len(head) else held
                rows += cut(pd.concat(whole) if len(whole) > 1 else whole[0])
                held = []
            held.append(pdf.iloc[starts[-1] if starts else 0 :])
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if held:
            yield pd.DataFrame(cut(pd.concat(held)), columns=columns)

    return stamped.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "n").mapInPandas(cut_all, out_schema)


def chunk_members(chunks: DataFrame, sents: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """One row per chunk and sentence with the stamp rule: first of the chunk, or a gap after the previous sentence."""
    numbered = number_sentences(sents)
    inside = chunks.select("session_id", "chunk_ord", "first", F.explode(F.sequence("first", "last")).alias("n"))
    rows = inside.join(numbered, ["session_id", "n"])
    w = Window.partitionBy("session_id", "chunk_ord").orderBy("n")  # a chunk is bounded by its size
    late = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) >= gap_minutes * 60_000_000
    return rows.withColumn("stamped", (F.col("n") == F.col("first")) | F.coalesce(late, F.lit(False)))


def chunk_records(chunks: DataFrame, hash: str = "blake2b", source: str = "chat", roles=("User", "Assistant")) -> DataFrame:
    """Vector-store records: id, text, hashes, length, ordinal, start."""
    c = chunks.withColumn("chunk_text", X.chunk_post("raw_text", roles))
    c = c.withColumn("sim", H.simhash64("chunk_text", hash))
    return c.select(
        # sessions may start in the same second
        F.format_string("%s_%s_%04d_%s", F.lit(source), F.date_format("start_ts", "yyyyMMdd_HHmmss"), F.col("chunk_ord"), F.substring(F.md5("session_id"), 1, 16)).alias("id"),
        "session_id",
        "chunk_ord",
        F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_iso"),
        "start_ts",
        "chunk_text",
        X.F.sha2("chunk_text", 256).alias("hash"),
        "sim",
        H.hex64("sim").alias("simhash64"),
        F.length("chunk_text").alias("len"),
        F.lit(source).alias("source"),
    )
