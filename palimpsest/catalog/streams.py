"""Queries that run a stream over a given table to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.detect import NOTES, PREF, SCORES
from palimpsest.catalog.kg import KG_EDGES, LINKED
from palimpsest.catalog.log import HASH
from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import HEX64, MSG, chunks, simhash
from palimpsest.functions import hashing as H
from palimpsest.plans import adapters as A
from palimpsest.streaming import jobs as J


class _Streams:
    """The given tables read as streams: adapters only see ``table``."""

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path):
        folder, name = path.rstrip("/").rsplit("/", 1)
        # as a pattern the name may be that of a file or of a folder of files; a plain path must be a folder
        return J.stream_table(self.spark, f"{folder}/{{{name}}}", self.spark.read.parquet(path).schema)


def streamed_messages(spark, sf):
    return A.messages(_Streams(spark), sf)


@query("stream_messages", f"WITH {MSG} SELECT id, session_id, role FROM messages WHERE role IN ('user','assistant') AND NOT is_summary")
def stream_messages(spark, sf):
    out = J.run_available(J.stream_messages(streamed_messages(spark, sf)), J.work_dir(spark, "messages"))
    return spark.read.parquet(out).select("id", "session_id", "role")


@query("stream_dedupe", f"WITH {MSG} SELECT DISTINCT session_id, role, {HASH} AS content_hash FROM messages")
def stream_dedupe(spark, sf):
    m = streamed_messages(spark, sf)
    out = J.run_available(J.stream_dedupe(m), J.work_dir(spark, "dedupe"))
    return spark.read.parquet(out).select("session_id", "role", "content_hash")


@query("stream_groups", f"""WITH {MSG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS nw FROM messages),
k AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY ts) AS i FROM g), w AS (SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS e, count(*) AS n FROM k GROUP BY session_id, i)
SELECT session_id, start::VARCHAR AS start, e::VARCHAR AS "end", n FROM w WHERE e <= (SELECT max(ts) FROM messages)""")
def stream_groups(spark, sf):
    return spark.read.parquet(J.run_available(J.stream_groups(streamed_messages(spark, sf)), J.work_dir(spark, "groups")))


@query("stream_turn_trigger", f"WITH {MSG} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS turn_no FROM messages WHERE role='assistant' AND NOT is_summary QUALIFY turn_no % 2 = 0")
def stream_turn_trigger(spark, sf):
    return spark.read.parquet(J.run_available(J.stream_turn_trigger(streamed_messages(spark, sf), 2), J.work_dir(spark, "turns")))


@query("stream_chunks", f"""WITH {chunks()}, lastm AS (SELECT session_id, max(ts) AS l FROM messages WHERE role IN ('user','assistant') GROUP BY 1)
SELECT session_id, chunk_ord, chars, start_ts::VARCHAR AS start_ts, md5(raw_text) AS h FROM raw_chunks JOIN lastm USING (session_id) WHERE l + INTERVAL 5 MINUTE < (SELECT max(ts) FROM messages)""")
def stream_chunks(spark, sf):
    out = spark.read.parquet(J.run_available(J.stream_chunks(streamed_messages(spark, sf)), J.work_dir(spark, "chunks")))
    return J.latest_chunks(out).select("session_id", "chunk_ord", "chars", "start_ts", F.md5("raw_text").alias("h"))


@query("stream_near_dup", f"""WITH RECURSIVE {simhash('documents', 'doc_id', 'text')},
firsts AS (SELECT sim, min(doc_id) AS first_at FROM sims GROUP BY sim), ranked AS (SELECT sim, first_at, row_number() OVER (ORDER BY first_at) AS k FROM firsts),
greedy AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS kept UNION ALL
 SELECT g.k+1, CASE WHEN len(list_filter(kept, lambda s: bit_count(xor(s, r.sim)) <= 3)) > 0 THEN kept ELSE list_append(kept, r.sim) END FROM greedy g JOIN ranked r ON r.k=g.k+1)
SELECT first_at AS id, {HEX64.format('sim')} AS simhash64 FROM firsts WHERE list_contains((SELECT kept FROM greedy WHERE k=(SELECT max(k) FROM greedy)), sim)""")
def stream_near_dup(spark, sf):
    docs = A.table(_Streams(spark), sf, "documents").select(F.col("doc_id").alias("id"), H.simhash64("text", "md5").alias("sim"))
    out = J.work_dir(spark, "neardup")
    J.run_batches(docs, J.near_dup_writer(out), out + "-marks")
    return spark.read.parquet(out).select("id", H.hex64("sim").alias("simhash64"))


@query("stream_detect", f"WITH {NOTES}, texts AS (SELECT id, text, 'n' AS src FROM notes), {SCORES}, {PREF} SELECT l.id, label, lower(p) AS preference FROM labelled l LEFT JOIN pref USING (id)")
def stream_detect(spark, sf):
    notes = A.notes(_Streams(spark), sf).withColumnRenamed("text", "content")
    out = J.run_available(J.stream_detect(notes).select("id", F.col("det.intent.label").alias("label"), F.col("det.slots")["preference"].alias("preference")), J.work_dir(spark, "detect"))
    return spark.read.parquet(out)


@query("stream_kg", f"WITH {LINKED}, {KG_EDGES} SELECT 'nodes' AS what, count(DISTINCT node_id) AS n FROM lk WHERE how='created' UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src_id, dst_id, type FROM ke)")
def stream_kg(spark, sf):
    out = J.work_dir(spark, "kg")
    # a batch of one file is read in one task, and parsed where it lies: its rows are dealt out first
    orders = A.table(_Streams(spark), sf, "orders").repartition(spark.sparkContext.defaultParallelism)
    dets = A.detections_of(orders, A.table(spark, sf, "customer"))
    J.run_batches(dets, J.kg_writer(lambda s: A.aliases(s, sf), out), out + "-marks")
    rows = [spark.read.parquet(f"{out}/{k}").select(F.lit(k).alias("what")) for k in ("nodes", "edges")]
    return rows[0].unionByName(rows[1]).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query("stream_need_summary", f"""WITH {MSG}, g AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE NOT is_summary) AS plain, max(ts) FILTER (WHERE is_summary) AS lt FROM messages GROUP BY 1)
SELECT session_id, total, plain, total>=4 AND (lt IS NULL OR date_diff('second', lt, TIMESTAMP '2024-01-05 00:00:00')//60 >= 30) AND plain>=3 AS due FROM g""")
def stream_need_summary(spark, sf):
    out = J.work_dir(spark, "need")
    J.run_batches(J.stream_need_summary(streamed_messages(spark, sf)), J.latest_writer(out), out + "-marks", "update")
    return J.summary_due(J.latest_rows(spark, out, "session_id"), F.lit("2024-01-05").cast("timestamp"), 4, 3, 30).drop("last_ts")
