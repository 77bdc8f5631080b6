"""Queries for vector search, hit selection and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import MSG, TRIMMED, VECTORS
from palimpsest.catalog.text import _LOGTXT, _log_text
from palimpsest.operators import retrieval as R
from palimpsest.plans import adapters as A

TOPK = f"""{VECTORS}, scored AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.vector::DOUBLE[], v.vector::DOUBLE[]) AS full_score, v.start_ts, v.hash, v.chunk_text, v.label FROM vectors q, vectors v),
top AS (SELECT *, round(full_score,6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, id) AS rank FROM scored QUALIFY rank <= 12)"""
SELECTED = f"""RECURSIVE {TOPK}, mx AS (SELECT query_id, CASE WHEN max(score)=0 THEN 1e-9 ELSE max(score) END AS t FROM top GROUP BY 1),
r AS (SELECT top.*, t, pow(0.5, greatest(date_diff('microsecond', start_ts, TIMESTAMP '2024-02-01 00:00:00')/3600000000.0, 0)/168.0) AS rec FROM top JOIN mx USING (query_id)),
c0 AS (SELECT query_id, 0::BIGINT AS rank, t AS prev, 0 AS n, false AS stop, false AS take, 0.0::DOUBLE AS comp, NULL::BIGINT AS id, NULL::DOUBLE AS score FROM mx),
walk AS (SELECT * FROM c0 UNION ALL
 SELECT query_id, rank, CASE WHEN take THEN score ELSE prev END, n + take::INT, clipped OR (NOT take AND dr >= 0.25 AND n >= 0) OR (n + take::INT >= 3), take AND NOT clipped, comp, id, score FROM (
  SELECT *, comp >= 0.35 AND NOT clipped AS take FROM (
   SELECT w.query_id, r.rank, w.prev, w.n, r.id, r.score, r.score < 0.01 AS clipped, greatest((w.prev-r.score)/greatest(w.prev,1e-9),0) AS dr,
     round(0.7*greatest(least(r.score/r.t,1.0),0.0) + 0.25*r.rec - 0.2*greatest((w.prev-r.score)/greatest(w.prev,1e-9),0), 9) AS comp
   FROM walk w JOIN r ON r.query_id=w.query_id AND r.rank=w.rank+1 WHERE NOT w.stop))),
sel AS (SELECT query_id, id, score, comp, row_number() OVER (PARTITION BY query_id ORDER BY comp DESC, rank)-1 AS place FROM walk WHERE take)"""


def _queries(spark, sf):
    return A.vectors(spark, sf).select(F.col("id").alias("query_id"), "vector")


def top(spark, sf):
    v = A.vectors(spark, sf)
    return R.vector_topk(_queries(spark, sf), v).join(v.drop("vector"), "id")


def selected(spark, sf):
    return R.select_hits(top(spark, sf), F.lit("2024-02-01").cast("timestamp")).join(A.vectors(spark, sf).drop("vector"), "id")


@query("vector_topk", f"WITH {TOPK} SELECT query_id, id, score, rank FROM top")
def vector_topk(spark, sf):
    return R.vector_topk(_queries(spark, sf), A.vectors(spark, sf))


@query("vector_filter", f"WITH {VECTORS}, s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.vector::DOUBLE[], v.vector::DOUBLE[]) AS score FROM vectors q, vectors v WHERE v.label > 3) SELECT query_id, id, round(score,6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5")
def vector_filter(spark, sf):
    return R.vector_topk(_queries(spark, sf), R.vector_filter(A.vectors(spark, sf), "label > 3"), 5)


@query("select_hits", f"WITH {SELECTED} SELECT query_id, id, place, round(comp,6) AS composite FROM sel")
def select_hits(spark, sf):
    return selected(spark, sf).select("query_id", "id", "place", F.round("composite", 6).alias("composite"))


@query("dedupe_hits", f"WITH {SELECTED} SELECT query_id, sel.id, place FROM sel JOIN vectors v ON v.id=sel.id QUALIFY row_number() OVER (PARTITION BY query_id, hash ORDER BY place)=1")
def dedupe_hits(spark, sf):
    return R.dedupe_hits(selected(spark, sf).withColumn("simhash64", F.lit(""))).select("query_id", "id", "place")


def _hit_texts(spark, sf):
    """Each session's log as the hits of a query: one hit per message, with its own stamp."""
    m = A.messages(spark, sf)
    text = F.concat(F.date_format("ts", "'['yyMMddEEE HH:mm'] '"), F.initcap("role"), F.lit(": "), F.regexp_replace("content", r"\n+", " "))
    return m.select(F.col("session_id").alias("query_id"), F.col("ts").alias("start_ts"), F.col("id").alias("place"), text.alias("chunk_text"))


@query("merge_hit_lines", rf"""WITH RECURSIVE {MSG}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts,id) AS k, date_trunc('minute',ts) AS mt FROM messages),
w AS (SELECT session_id, id, k, true AS keep, mt AS last FROM o WHERE k=1 UNION ALL
 SELECT o.session_id, o.id, o.k, o.mt - w.last >= INTERVAL 5 MINUTE, CASE WHEN o.mt - w.last >= INTERVAL 5 MINUTE THEN o.mt ELSE w.last END FROM w JOIN o ON o.session_id=w.session_id AND o.k=w.k+1)
SELECT session_id AS query_id, md5(string_agg(CASE WHEN keep THEN strftime(ts,'[%y%m%d%a %H:%M] ') ELSE '' END || upper(role[1]) || role[2:] || ': ' || regexp_replace(content,'\n+',' ','g'), chr(10) ORDER BY w.k)) AS h
FROM w JOIN messages USING (session_id, id) GROUP BY 1""")
def merge_hit_lines(spark, sf):
    return R.merge_hit_lines(_hit_texts(spark, sf)).select("query_id", F.md5("text").alias("h"))


_UNPACK = rf"""{_LOGTXT}, ul AS (SELECT session_id, unnest(l) AS line, generate_subscripts(l,1) AS i FROM (SELECT session_id, string_split(t,chr(10)) AS l FROM txt)),
uh AS (SELECT session_id, {TRIMMED.format('line')} AS line, i FROM ul WHERE {TRIMMED.format('line')}<>''),
ug AS (SELECT *, regexp_matches(line,'^(\[\d{{6}}\w* \d{{2}}:\d{{2}}\]\s*)?(User|Assistant):') AS hd, sum(regexp_matches(line,'^(\[\d{{6}}\w* \d{{2}}:\d{{2}}\]\s*)?(User|Assistant):')::INT) OVER (PARTITION BY session_id ORDER BY i) AS g FROM uh),
ut AS (SELECT *, CASE WHEN hd THEN regexp_extract(line,'^(\[\d{{6}}\w* \d{{2}}:\d{{2}}\])',1) || CASE WHEN line LIKE '[%' THEN ' ' ELSE '' END || trim(regexp_extract(line,'^(\[\d{{6}}\w* \d{{2}}:\d{{2}}\]\s*)?(User|Assistant):\s*(.*)$',3)) ELSE line END AS t,
 CASE WHEN hd THEN lower(regexp_extract(line,'^(\[\d{{6}}\w* \d{{2}}:\d{{2}}\]\s*)?(User|Assistant):',2)) END AS role FROM ug WHERE g>0),
unp AS (SELECT session_id, g-1 AS msg_no, max(role) AS role, string_agg(t, chr(10) ORDER BY i) AS content FROM ut GROUP BY 1,2)"""


@query("unpack_transcript", f"WITH {MSG}, {_UNPACK} SELECT session_id, msg_no::BIGINT AS msg_no, role, md5(content) AS h FROM unp")
def unpack_transcript(spark, sf):
    return R.unpack_transcript(_log_text(spark, sf), "session_id", "t").select("session_id", "msg_no", "role", F.md5("content").alias("h"))


SQUEEZED = r"regexp_replace(line,'\s+',' ','g')"


@query("dedupe_lines", rf"""WITH docs AS (SELECT lang, doc_id, unnest(l) AS line, generate_subscripts(l,1) AS i FROM (SELECT lang, doc_id, string_split(text,chr(10)) AS l FROM documents)),
n AS (SELECT *, {TRIMMED.format(SQUEEZED)} AS norm FROM docs), f AS (SELECT * FROM n WHERE norm<>'' QUALIFY row_number() OVER (PARTITION BY lang, norm ORDER BY doc_id, i)=1)
SELECT lang, doc_id AS msg_no, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS h FROM f GROUP BY 1,2""")
def dedupe_lines(spark, sf):
    rows = A.table(spark, sf, "documents").select("lang", F.col("doc_id").alias("msg_no"), F.lit("user").alias("role"), F.col("text").alias("content"))
    out = R.dedupe_lines(rows, "lang")
    return out.select("lang", "msg_no", F.size(F.split("content", "\n")).alias("lines"), F.md5("content").alias("h"))


@query("memory_cap", rf"SELECT doc_id, md5(substr({TRIMMED.format("'[Memory v2] ' || text")},1,6000)) AS h FROM documents WHERE text<>''")
def memory_cap(spark, sf):
    return A.table(spark, sf, "documents").where("text <> ''").select("doc_id", F.md5(R.memory_cap("text")).alias("h"))


@query("memory_splice", f"""WITH {MSG}, {_UNPACK} SELECT session_id, 0::BIGINT AS section, id AS ord, role FROM messages WHERE role='system'
 UNION ALL SELECT session_id, 1, msg_no::BIGINT, role FROM unp UNION ALL SELECT session_id, 2, id, role FROM messages WHERE role<>'system'""")
def memory_splice(spark, sf):
    m = A.messages(spark, sf)
    cols = ["session_id", "ord", "role"]
    system = m.where("role = 'system'").withColumn("ord", F.col("id")).select(*cols)
    rec = R.unpack_transcript(_log_text(spark, sf), "session_id", "t").withColumn("ord", F.col("msg_no").cast("long")).select(*cols)
    return R.memory_splice(system, rec, m.where("role <> 'system'").withColumn("ord", F.col("id")).select(*cols))
