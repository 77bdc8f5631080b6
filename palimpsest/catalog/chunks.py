"""Queries for chunking and duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import HEX64, SENTS, chunks, concat_roles, simhash
from palimpsest.functions import hashing as H
from palimpsest.operators import chunks as C
from palimpsest.operators import neardup as N
from palimpsest.plans import adapters as A
from palimpsest.plans.chunk_run import chunk_inventory, chunk_run, dry_run_report
from palimpsest.sources import sinks

RECORDS = (
    chunks()
    + ", kc AS (SELECT *, session_id || '/' || chunk_ord AS ck FROM raw_chunks), "
    + concat_roles("kc", "ck", r"regexp_replace(raw_text,'\n{2,}',chr(10),'g')", "posted")
    + """, recs AS (SELECT strftime(start_ts,'chat_%Y%m%d_%H%M%S_') || lpad(CAST(chunk_ord AS VARCHAR),4,'0') || '_' || substr(md5(session_id),1,16) AS id, session_id, chunk_ord, start_ts,
 strftime(start_ts,'%Y-%m-%dT%H:%M:%S') AS start_iso, t AS chunk_text, sha256(t) AS hash, length(t) AS len, ck FROM kc JOIN posted USING (ck)), """
    + simhash("recs", "ck", "chunk_text", "rsim")
    + """, firsts AS (SELECT sim, min((start_ts, session_id, chunk_ord)) AS first_at FROM (SELECT * FROM recs JOIN rsim USING (ck)) GROUP BY sim),
ranked AS (SELECT sim, row_number() OVER (ORDER BY first_at) AS k FROM firsts),
greedy AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS kept UNION ALL
 SELECT g.k+1, CASE WHEN len(list_filter(kept, lambda s: bit_count(xor(s, r.sim)) <= 3)) > 0 THEN kept ELSE list_append(kept, r.sim) END FROM greedy g JOIN ranked r ON r.k=g.k+1),
winners AS (SELECT unnest(kept) AS sim FROM greedy WHERE k=(SELECT max(k) FROM greedy)),
kept_recs AS (SELECT r.* FROM recs r JOIN rsim USING (ck) JOIN firsts f USING (sim) JOIN winners USING (sim) WHERE (r.start_ts, r.session_id, r.chunk_ord) = f.first_at)"""
)


def _sents(spark, sf):
    return C.timed_sentences(A.messages(spark, sf))


@query("timed_sentences", f"WITH {SENTS} SELECT session_id, id, pos, len, md5(text) AS h, n FROM numbered")
def timed_sentences(spark, sf):
    return C.number_sentences(_sents(spark, sf)).select("session_id", "id", "pos", "len", F.md5("text").alias("h"), "n")


@query("slide_chunks", f"WITH {chunks()} SELECT session_id, chunk_ord, first, last, chars, start_ts::VARCHAR AS start_ts, md5(raw_text) AS h FROM raw_chunks")
def slide_chunks(spark, sf):
    return C.slide_chunks(_sents(spark, sf)).select("session_id", "chunk_ord", "first", "last", "chars", "start_ts", F.md5("raw_text").alias("h"))


# short chunks and blocks, so that chunks of one session come from several blocks
@query("slide_chunks_blocks", f"WITH {chunks(20, 8)} SELECT session_id, chunk_ord, first, last, chars, start_ts::VARCHAR AS start_ts, md5(raw_text) AS h FROM raw_chunks")
def slide_chunks_blocks(spark, sf):
    out = C.slide_chunks(_sents(spark, sf), 20, 8, block=22)
    return out.select("session_id", "chunk_ord", "first", "last", "chars", "start_ts", F.md5("raw_text").alias("h"))


@query("chunk_stamps", f"WITH {chunks()} SELECT session_id, chunk_ord, n, stamped FROM members")
def chunk_stamps(spark, sf):
    s = _sents(spark, sf)
    return C.chunk_members(C.slide_chunks(s), s).select("session_id", "chunk_ord", "n", "stamped")


@query("chunk_post", f"WITH {chunks()}, kc AS (SELECT *, session_id || '/' || chunk_ord AS ck FROM raw_chunks), {concat_roles('kc', 'ck', 'raw_text', 'posted')} SELECT session_id, chunk_ord, t FROM kc JOIN posted USING (ck)")
def chunk_post(spark, sf):
    return C.chunk_records(C.slide_chunks(_sents(spark, sf))).select("session_id", "chunk_ord", F.col("chunk_text").alias("t"))


@query("chunk_records", f"WITH {RECORDS} SELECT id, session_id, chunk_ord, start_iso, hash, {HEX64.format('sim')} AS simhash64, len, 'chat' AS source FROM recs JOIN rsim USING (ck)")
def chunk_records(spark, sf):
    return C.chunk_records(C.slide_chunks(_sents(spark, sf)), hash="md5").select("id", "session_id", "chunk_ord", "start_iso", "hash", "simhash64", "len", "source")


@query("dedupe_exact", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_exact(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return N.dedupe_exact(docs, "h", ["doc_id"]).select("h", "doc_id")


@query("dedupe_near", f"""WITH RECURSIVE {simhash('documents', 'doc_id', 'text')},
firsts AS (SELECT sim, min(doc_id) AS first_at FROM sims GROUP BY sim), ranked AS (SELECT sim, first_at, row_number() OVER (ORDER BY first_at) AS k FROM firsts),
greedy AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS kept UNION ALL
 SELECT g.k+1, CASE WHEN len(list_filter(kept, lambda s: bit_count(xor(s, r.sim)) <= 3)) > 0 THEN kept ELSE list_append(kept, r.sim) END FROM greedy g JOIN ranked r ON r.k=g.k+1)
SELECT first_at AS doc_id, {HEX64.format('sim')} AS simhash64 FROM firsts WHERE list_contains((SELECT kept FROM greedy WHERE k=(SELECT max(k) FROM greedy)), sim)""")
def dedupe_near(spark, sf):
    docs = A.spread(A.table(spark, sf, "documents")).select("doc_id", H.simhash64("text", "md5").alias("sim"))
    return N.dedupe_near(docs, ["doc_id"]).select("doc_id", H.hex64("sim").alias("simhash64"))


@query("chunk_run", f"WITH {RECORDS} SELECT id, session_id, chunk_ord, hash, len FROM kept_recs")
def chunk_run_q(spark, sf):
    return chunk_run(A.messages(spark, sf), hash="md5").select("id", "session_id", "chunk_ord", "hash", "len")


@query("chunk_inventory", f"WITH {RECORDS} SELECT session_id, count(*) AS n_chunks, round(avg(len),6) AS avg_len, min(start_iso) AS first_start, max(start_iso) AS last_start FROM kept_recs GROUP BY 1")
def chunk_inventory_q(spark, sf):
    return chunk_inventory(chunk_run(A.messages(spark, sf), hash="md5"))


@query("chunk_dry_run", f"WITH {RECORDS} SELECT count(*) AS upserts, count(DISTINCT session_id) AS sessions, CAST(sum(len) AS BIGINT) AS chars FROM kept_recs")
def chunk_dry_run(spark, sf):
    return dry_run_report(chunk_run(A.messages(spark, sf), hash="md5"))


@query("sink_chunks", "SELECT concat('d',d.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE quality*1000+toxic END AS len, CASE WHEN l.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def sink_chunks(spark, sf):
    stored = A.table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "n_chars AS len")
    batch = A.table(spark, sf, "labels").selectExpr("concat('d', doc_id) AS id", "cast(quality * 1000 + toxic AS long) AS len")
    return sinks.merge_chunks(stored, batch, ["len"])
