"""Queries for the text and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.log import PUNCT_SQL
from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import HEX64, MSG, TRIMMED, concat_roles, sentences, simhash
from palimpsest.functions import hashing as H
from palimpsest.functions import text as X
from palimpsest.plans import adapters as A

REPLIES_SQL = r"""replies AS (SELECT o_orderkey AS id, o_custkey AS owner, 'Noted ' || o_orderkey || '. ' || (CASE o_orderkey % 9
 WHEN 0 THEN '~~~action' || chr(10) || '{"intent":"create_task","args":{"name":"' || name || '","date":"' || d || '","importance":"' || imp || '"}}' || chr(10) || '~~~'
 WHEN 1 THEN '~~~action' || chr(10) || '{"intent":"update_task","args":{"name":"' || name || '","updates":["seen ' || o_orderkey%5 || '"]}}' || chr(10) || '~~~'
 WHEN 2 THEN '~~~action' || chr(10) || '{"intent":"delete_task","args":{"name":"' || name || '","date":"' || d || '"}}' || chr(10) || '~~~'
 WHEN 3 THEN '~~~action {"intent":"finish_task","args":{"name":"' || name || '",}} ~~~'
 WHEN 4 THEN '~~~memory' || chr(10) || '{"op":"upsert","fact":"likes ' || o_orderkey%13 || '","key":"K' || o_orderkey%3 || '"}' || chr(10) || '~~~ done'
 WHEN 5 THEN '~~~memory' || chr(10) || '{"op":"delete","fact":"likes ' || o_orderkey%13 || '","key":"' || CASE WHEN o_orderkey%2=0 THEN '*' ELSE 'K' || o_orderkey%3 END || '"}' || chr(10) || '~~~'
 WHEN 6 THEN '~~~interest' || chr(10) || '{"topics":["' || imp || '","b","c","d","e"],"reason":"r' || o_orderkey%4 || '","confidence":' || CASE WHEN o_orderkey%2=0 THEN '1.5' ELSE '0.4' END || '}' || chr(10) || '~~~ ~~~Other {"a":1} ~~~'
 WHEN 7 THEN '~~~action {oops} ~~~ and ~~~debug {"op":"on"} ~~~' ELSE 'no block here' END) AS text
 FROM (SELECT *, concat('Order ', o_orderkey%97) AS name, strftime(o_orderdate,'%Y-%m-%d') AS d, lower(substr(o_orderpriority,3)) AS imp FROM orders))"""

_FN = "'function result: {\"p\":{\"q\":[' || id || ']}} ' || text"


def _docs(spark, sf):
    return A.table(spark, sf, "documents")


def _h(c):
    return F.md5(c).alias("h")


@query("pre_sanitize", "WITH " + REPLIES_SQL + r""" SELECT id, regexp_replace(regexp_replace('function result: {"p":{"q":[' || id || ']}} ' || text, '~~~(action|memory|interest|debug)\s*.*?~~~','[cmd]','gs'), 'function\sresult:\s*\{([^{}]|\{[^{}]*\})*\}','function result: [result]','g') AS t FROM replies""")
def pre_sanitize(spark, sf):
    return A.reply_texts(spark, sf).select("id", X.pre_sanitize(F.expr("concat('function result: {\"p\":{\"q\":[', id, ']}} ', text)")).alias("t"))


@query("filter_function_result", rf"WITH {REPLIES_SQL} SELECT id, 'function result: [result] ' || text AS t FROM replies")
def filter_function_result(spark, sf):
    return A.reply_texts(spark, sf).select("id", X.filter_function_result(F.expr("concat('function result: {\"p\":{\"q\":[', id, ']}} ', text)")).alias("t"))


@query("filter_memory_content", "WITH " + REPLIES_SQL + " SELECT id, regexp_replace('function result: [result]} ' || text, '~~~.*?~~~','[cmd]','gs') AS t FROM replies")
def filter_memory_content(spark, sf):
    return A.reply_texts(spark, sf).select("id", X.filter_memory_content(F.expr("concat('function result: {\"p\":{\"q\":[', id, ']}} ', text)")).alias("t"))


@query("split_sentences", f"WITH s AS (SELECT doc_id, {sentences('text')} AS l FROM documents) SELECT doc_id, generate_subscripts(l,1)-1 AS pos, md5(unnest(l)) AS h FROM s")
def split_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(X.split_sentences("text")).alias("pos", "s")).select("doc_id", "pos", F.md5("s").alias("h"))


@query("collapse_newlines", r"SELECT doc_id, md5(regexp_replace(text,'\n{2,}',chr(10),'g')) AS h FROM documents")
def collapse_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", _h(X.collapse_newlines("text")))


_LOGTXT = "txt AS (SELECT session_id, string_agg(CASE WHEN turn_min%3=0 THEN strftime(ts,'[%y%m%d%a %H:%M] ') ELSE '' END || CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || content, chr(10) ORDER BY id) AS t FROM (SELECT *, minute(ts) AS turn_min FROM messages) GROUP BY 1)"


def _log_text(spark, sf):
    from palimpsest.operators.ordered import join_ordered

    m = A.messages(spark, sf)
    stamp = F.when(F.minute("ts") % 3 == 0, F.concat(X.stamp_long("ts"), F.lit(" "))).otherwise("")
    who = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("")
    return m.withColumn("line", F.concat(stamp, who, "content")).groupBy("session_id").agg(join_ordered("line", ["id"], "\n").alias("t"))


@query("concat_roles", f"WITH {MSG}, {_LOGTXT}, {concat_roles('txt', 'session_id', 't')} SELECT session_id, md5(t) AS h FROM joined")
def concat_roles_q(spark, sf):
    return _log_text(spark, sf).select("session_id", _h(X.concat_roles("t")))


@query("normalize_nfc", f"SELECT doc_id, md5({TRIMMED.format('nfc_normalize(nfd)')}) AS h FROM (SELECT doc_id, replace(text,'é','e' || chr(769)) AS nfd FROM documents)")
def normalize_nfc(spark, sf):
    return _docs(spark, sf).select("doc_id", _h(X.normalize_nfc(F.replace("text", F.lit("é"), F.lit("é")))))


@query("sanitize_punct", f"SELECT doc_id, md5({PUNCT_SQL.format('text')}) AS h FROM documents")
def sanitize_punct(spark, sf):
    return _docs(spark, sf).select("doc_id", _h(X.sanitize_punct("text")))


@query("strip_fences", rf"WITH {REPLIES_SQL} SELECT id, trim(regexp_replace(text,'~~~\w+\s*\{{[\s\S]*?\}}\s*~~~','','g')) AS t FROM replies")
def strip_fences(spark, sf):
    return A.reply_texts(spark, sf).select("id", X.strip_fences("text").alias("t"))


_WS = r"regexp_replace({0},'\s+',' ','g')"


@query("detector_norm", f"SELECT doc_id, md5(lower({_WS.format(TRIMMED.format('text'))}) || '-') AS h FROM documents")
def detector_norm(spark, sf):
    return _docs(spark, sf).select("doc_id", _h(X.detector_norm("text", "-")))


@query("alias_norm", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)),'[''".,()\[\]{}_]+',' ','g'),'\s+',' ','g'))) AS h FROM documents""")
def alias_norm(spark, sf):
    return _docs(spark, sf).select("doc_id", _h(X.alias_norm("text")))


@query("normalize_title", rf"SELECT doc_id, substr({TRIMMED.format(_WS.format('text'))},1,255) AS t FROM documents")
def normalize_title(spark, sf):
    return _docs(spark, sf).select("doc_id", X.normalize_title("text").alias("t"))


_STOPS = "['the','a','an','and','or','to','of','in','is','are','was','were','on','for','with','at','by','it','this','that']"


@query("tokenize_cjk", f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text),'[a-z0-9_]+'), lambda w: length(w)>=2 AND NOT list_contains({_STOPS},w)))) AS l FROM documents)
SELECT doc_id, len(l) AS n, md5(array_to_string(l,' ')) AS h FROM t""")
def tokenize_cjk(spark, sf):
    t = F.array_sort(X.tokenize_cjk("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n"), _h(F.array_join(t, " ")))


@query("rough_tokens", r"SELECT page_id, CAST(ceil(c + greatest(0, strlen(html)-3*c)/4.0) AS BIGINT) AS n FROM (SELECT *, len(regexp_extract_all(html,'[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]')) AS c FROM pages)")
def rough_tokens(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.rough_tokens("html").alias("n"))


@query("json_lenient", "SELECT event_id, CASE WHEN event_id%4=3 THEN NULL ELSE CAST(json_extract_string(props,'$.k') AS BIGINT) END AS k FROM events")
def json_lenient(spark, sf):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', ', }') WHEN 2 THEN replace(props, '\"', '”') ELSE concat(props, '{') END")
    return A.table(spark, sf, "events").select("event_id", F.get_json_object(X.json_lenient(raw), "$.k").cast("long").alias("k"))


@query("stamp_format", "SELECT event_id, strftime(ts,'[%m.%d%a %H:%M] ') AS short, strftime(ts,'[%y%m%d%a %H:%M]') AS long FROM events")
def stamp_format(spark, sf):
    return A.table(spark, sf, "events").select("event_id", X.stamp_short("ts").alias("short"), X.stamp_long("ts").alias("long"))


@query("parse_iso_ts", "SELECT event_id, CASE event_id%3 WHEN 0 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR,'%Y-%m-%d %H:%M:%S') END AS t FROM events")
def parse_iso_ts(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+02:00"))).otherwise("soon")
    return A.table(spark, sf, "events").select("event_id", X.parse_iso_ts(raw).alias("t"))


@query("recency_weight", "SELECT event_id, round(CASE WHEN event_id%10=0 THEN 0.5 ELSE pow(0.5, greatest(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00')/3600000000.0, 0)/168.0) END, 6) AS w FROM events")
def recency_weight(spark, sf):
    ts = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return A.table(spark, sf, "events").select("event_id", F.round(X.recency_weight(ts, F.lit("2024-01-20").cast("timestamp")), 6).alias("w"))


@query("day_from_ts", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR,'%Y-%m-%d') AS d FROM events")
def day_from_ts(spark, sf):
    return A.table(spark, sf, "events").select("event_id", X.day_from_ts("ts").alias("d"))  # January: UTC-5


@query("content_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_sha256(spark, sf):
    return _docs(spark, sf).select("doc_id", H.content_sha256("text").alias("h"))


@query("simhash64", f"WITH {simhash('documents', 'doc_id', 'text')} SELECT doc_id, {HEX64.format('sim')} AS h FROM sims")
def simhash64(spark, sf):
    return _docs(spark, sf).select("doc_id", H.hex64(H.simhash64("text", "md5")).alias("h"))


@query("hamming64", "SELECT doc_id, bit_count(xor(('0x'||substr(md5(text),1,16))::UBIGINT, ('0x'||substr(md5(lower(text)),1,16))::UBIGINT)) AS d FROM documents")
def hamming64(spark, sf):
    half = lambda c: F.conv(F.substring(F.md5(c), 1, 16), 16, -10).cast("long")
    return _docs(spark, sf).select("doc_id", H.hamming64(half("text"), half(F.lower("text"))).alias("d"))


@query("lang_hints", r"SELECT doc_id, regexp_matches(text,'\p{Han}') AS has_zh, regexp_matches(text,'[àâçéèêëîïôùûüÿœæ]') AS has_fr FROM documents")
def lang_hints(spark, sf):
    return _docs(spark, sf).select("doc_id", X.has_han("text").alias("has_zh"), X.has_french("text").alias("has_fr"))
