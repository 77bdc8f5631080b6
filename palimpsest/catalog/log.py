"""Queries over the message log: scans, sinks, row rules, history windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import MSG, SHOWN, TRIMMED
from palimpsest.functions import text as X
from palimpsest.operators import history as H
from palimpsest.operators import messages as M
from palimpsest.plans import adapters as A
from palimpsest.sources import messages as S

NOW = "2024-02-15 12:00:00"
HASH = "sha256(content || '|' || '|')"

# log with a few ephemeral, trace and nudge rows derived from the turns
EVENTFUL = """CASE WHEN role='system' THEN 'Memories: ' || content WHEN role='assistant' AND {m}=1 THEN 'function result: {{"a":{{"b":1}}}} ' || content
 WHEN role='user' AND {m}=2 THEN 'Continue ' || content ELSE content END"""
EVENTFUL_ROLE = "CASE WHEN role='assistant' AND {m}=1 THEN 'system' ELSE role END"
_M = "((id - 1) % 1000)"


def eventful(spark, sf):
    return A.messages(spark, sf).withColumn("content", F.expr(EVENTFUL.format(m=_M))).withColumn("role", F.expr(EVENTFUL_ROLE.format(m=_M)))


EVENTFUL_SQL = MSG + f""", ev AS (
  SELECT id, session_id, ts, {EVENTFUL.format(m=_M).replace('{{', '{').replace('}}', '}')} AS content, {EVENTFUL_ROLE.format(m=_M)} AS role, role AS old_role FROM messages)"""


@query("scan_messages", f"WITH {MSG} SELECT id, session_id, role, ts::VARCHAR AS ts FROM messages WHERE role IN ('user','assistant') AND NOT is_summary AND id > 0")
def scan_messages(spark, sf):
    return S.scan_messages(A.messages(spark, sf), 0).select("id", "session_id", "role", "ts")


@query("scan_messages_since", f"WITH {MSG} SELECT id, session_id, role FROM messages WHERE role IN ('user','assistant') AND (ts > TIMESTAMP '2024-01-01 00:01:00' OR (ts = TIMESTAMP '2024-01-01 00:01:00' AND id > 2))")
def scan_messages_since(spark, sf):
    return S.scan_messages_since(A.messages(spark, sf), "2024-01-01 00:01:00", after_id=2).select("id", "session_id", "role")


@query("sink_messages", f"""WITH {MSG}, target AS (SELECT DISTINCT session_id, role, {HASH} AS h FROM messages WHERE role='assistant'),
batch AS (SELECT *, {HASH} AS h FROM messages)
SELECT session_id, role, h AS content_hash, min(id) AS id FROM batch b WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.session_id=b.session_id AND t.role=b.role AND t.h=b.h) GROUP BY 1,2,3""")
def sink_messages(spark, sf):
    m = A.messages(spark, sf)
    return S.new_messages(m.unionByName(m), m.where("role = 'assistant'"), "content").select("session_id", "role", "content_hash", "id")


@query("message_id_lookup", f"WITH {MSG}, h AS (SELECT *, {HASH} AS hh FROM messages) SELECT id, max(id) OVER (PARTITION BY session_id, hh) AS stored_id FROM h")
def message_id_lookup(spark, sf):
    m = A.messages(spark, sf)
    return S.message_id_lookup(m, m).select("id", "stored_id")


_MARKS = "marks AS (SELECT max(ts) AS last_message_ts, max(id) AS last_id, session_id FROM messages GROUP BY session_id)"


def _marks(m):
    return m.groupBy("session_id").agg(F.max("ts").alias("last_message_ts"), F.max("id").alias("last_id")).drop("session_id").withColumn("processed_at", F.lit(None).cast("timestamp"))


@query("hwm_read", f"WITH {MSG}, {_MARKS} SELECT max(last_message_ts)::VARCHAR AS last_message_ts, max(last_id) AS last_id FROM marks")
def hwm_read(spark, sf):
    return S.hwm_read(_marks(A.messages(spark, sf)))


@query("hwm_write", f"WITH {MSG}, {_MARKS} SELECT last_message_ts::VARCHAR AS last_message_ts, last_id FROM marks UNION ALL SELECT max(ts)::VARCHAR, max(id) FROM messages")
def hwm_write(spark, sf):
    m = A.messages(spark, sf)
    return S.hwm_write(_marks(m), m, NOW).select("last_message_ts", "last_id")


@query("role_display", f"WITH {MSG} SELECT {SHOWN} AS shown, count(*) AS n FROM messages GROUP BY 1")
def role_display(spark, sf):
    return A.messages(spark, sf).groupBy(X.role_display("role").alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_ephemeral", f"WITH {EVENTFUL_SQL} SELECT id, role FROM ev WHERE NOT (role='system' AND (lower(content) LIKE 'memories:%'))")
def filter_ephemeral(spark, sf):
    return M.filter_ephemeral(eventful(spark, sf)).select("id", "role")


@query("filter_first_ephemeral", f"""WITH {EVENTFUL_SQL}, s AS (SELECT id, session_id, CASE WHEN content LIKE 'Memories:%' THEN 'f' END AS k FROM ev WHERE role='system'),
f AS (SELECT session_id, min(id) AS id FROM s WHERE k='f' GROUP BY 1) SELECT id, session_id FROM s WHERE id NOT IN (SELECT id FROM f)""")
def filter_first_ephemeral(spark, sf):
    return M.filter_first_ephemeral(eventful(spark, sf)).select("id", "session_id")


@query("persist_plan", f"""WITH {EVENTFUL_SQL}, k AS (SELECT *, CASE WHEN role='system' AND content LIKE 'function result: %' THEN 'trace' WHEN role='user' AND content<>'' THEN 'user' END AS mark FROM ev),
p AS (SELECT id, lag(mark) OVER (PARTITION BY session_id ORDER BY id) AS before FROM k WHERE mark IS NOT NULL)
SELECT k.id, CASE WHEN content='' THEN 'skip_empty' WHEN mark='trace' THEN 'router_trace' WHEN mark='user' AND before='trace' AND lower(content) LIKE 'continue%' THEN 'skip_nudge'
 WHEN role='system' AND lower(content) LIKE 'memories:%' THEN 'skip_ephemeral' WHEN role='assistant' THEN 'skip_assistant' ELSE 'insert' END AS op FROM k LEFT JOIN p USING (id)""")
def persist_plan(spark, sf):
    return M.persist_plan(eventful(spark, sf)).select("id", "op")


_TAIL = "la AS (SELECT session_id, coalesce(max(id) FILTER (WHERE role='assistant'),-1) AS a FROM messages GROUP BY 1), tail AS (SELECT m.* FROM messages m JOIN la USING (session_id) WHERE id > a)"


@query("client_delta", f"""WITH {MSG}, {_TAIL}, lu AS (SELECT session_id, max(id) AS u FROM tail WHERE role='user' GROUP BY 1)
SELECT id, role, md5(CASE WHEN id=u THEN '[02.15Thu 08:00] ' || content ELSE content END) AS h FROM tail LEFT JOIN lu USING (session_id) WHERE content<>''""")
def client_delta(spark, sf):
    return M.client_delta(A.messages(spark, sf), F.lit(NOW).cast("timestamp")).select("id", "role", F.md5("content").alias("h"))


@query("tail_user_text", f"WITH {MSG}, {_TAIL} SELECT session_id, md5(string_agg({TRIMMED.format('content')}, chr(10) ORDER BY id)) AS h FROM tail WHERE role='user' AND {TRIMMED.format('content')}<>'' GROUP BY 1")
def tail_user_text(spark, sf):
    return M.tail_user_text(A.messages(spark, sf)).select("session_id", F.md5("text").alias("h"))


@query("last_k_turns", f"""WITH {MSG}, r AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY session_id ORDER BY id) AS st FROM messages WHERE role IN ('user','assistant')),
k AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS q FROM r WHERE st),
f AS (SELECT session_id, min(id) AS since, count(*) AS turns FROM k WHERE q<=5 GROUP BY 1)
SELECT session_id, turns, md5(string_agg({SHOWN} || ': ' || {TRIMMED.format('content')}, chr(10) ORDER BY id)) AS h FROM r JOIN f USING (session_id) WHERE id>=since GROUP BY 1,2""")
def last_k_turns(spark, sf):
    return M.last_k_turns(A.messages(spark, sf)).select("session_id", "turns", F.md5("history").alias("h"))


@query("latest_user", f"WITH {MSG} SELECT session_id, md5(arg_max({TRIMMED.format('content')}, id)) AS h FROM messages WHERE role='user' AND {TRIMMED.format('content')}<>'' GROUP BY 1")
def latest_user(spark, sf):
    return M.latest_user(A.messages(spark, sf)).select("session_id", F.md5("text").alias("h"))


@query("alternate_roles", f"WITH {MSG}, r AS (SELECT id, role, lag(role) OVER (PARTITION BY session_id ORDER BY id) AS p FROM messages) SELECT id, role FROM r WHERE role IS DISTINCT FROM p")
def alternate_roles(spark, sf):
    return M.alternate_roles(A.messages(spark, sf)).select("id", "role")


@query("role_counts", f"WITH {MSG} SELECT role, count(*) AS n FROM messages GROUP BY 1")
def role_counts(spark, sf):
    return M.role_counts(A.messages(spark, sf))


@query("drop_tools", "SELECT o_orderkey*16 AS id, CAST(NULL AS VARCHAR) AS tool_calls_json FROM orders")
def drop_tools(spark, sf):
    return M.drop_tools(A.tool_log(spark, sf)).select("id", "tool_calls_json")


_RESP = """CASE id % 5 WHEN 0 THEN to_json(named_struct('content', array(named_struct('type','thinking','text','x'), named_struct('type','text','text',content))))
WHEN 1 THEN to_json(named_struct('output_text', content)) WHEN 2 THEN to_json(named_struct('output', array(named_struct('content', array(named_struct('text', content))))))
WHEN 3 THEN to_json(named_struct('choices', array(named_struct('message', named_struct('content', '', 'reasoning_content', content)))))
ELSE to_json(named_struct('choices', array(named_struct('message', named_struct('content', content))))) END"""
_SHAPE = "CASE WHEN id % 5 = 0 THEN 'blocks' WHEN id % 5 < 3 THEN 'output' ELSE 'choices' END"
PUNCT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},'[ \t](?:—|–|--|-)[ \t]',', ','g'),'\s*,\s*,+',', ','g'),'[ \t]{{2,}}',' ','g'),'\n+',chr(10)||chr(10),'g'),'^\s+|\s+$','','g')"""


@query("response_text", f"WITH {MSG} SELECT id, md5({PUNCT_SQL.format('content')}) AS h FROM messages")
def response_text(spark, sf):
    m = A.messages(spark, sf).withColumn("resp", F.expr(_RESP)).withColumn("shape", F.expr(_SHAPE))
    return m.select("id", F.md5(M.response_text(F.col("resp"), F.col("shape"))).alias("h"))


@query("response_tool_calls", """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT o_orderkey*16 AS id, count(l_linenumber) AS n, coalesce(min('c'||o_orderkey||'_'||l_linenumber),'') AS first_id FROM orders LEFT JOIN li ON l_orderkey=o_orderkey GROUP BY o_orderkey""")
def response_tool_calls(spark, sf):
    rows = A.tool_log(spark, sf).where("role = 'assistant'")
    resp = F.when(F.col("tool_calls_json").isNotNull(), F.concat(F.lit('{"content":{"tool_calls":'), F.col("tool_calls_json"), F.lit("}}"))).otherwise('{"content":"x"}')
    calls = M.response_tool_calls(resp)
    return rows.select("id", F.size(calls).alias("n"), F.coalesce(F.array_min(F.transform(calls, lambda c: c["id"])), F.lit("")).alias("first_id"))


# --- history windows ---------------------------------------------------------------------------------------
@query("last_n_messages", f"WITH {MSG} SELECT id, session_id FROM messages WHERE role IN ('user','tool','assistant') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 3")
def last_n_messages(spark, sf):
    return H.last_n_messages(A.messages(spark, sf), 3).select("id", "session_id")


@query("prepare_history", f"WITH {MSG}, r AS (SELECT * FROM messages WHERE role IN ('user','tool','assistant') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 4) SELECT id, md5(content) AS h, count(*) OVER (PARTITION BY session_id) = 4 AS was_trimmed FROM r")
def prepare_history(spark, sf):
    return H.prepare_history(A.messages(spark, sf), 4).select("id", F.md5("content").alias("h"), "was_trimmed")


@query("group_stamps", f"""WITH RECURSIVE {MSG}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts,id) AS k FROM messages),
w AS (SELECT session_id, id, ts, k, true AS stamped, ts AS last FROM o WHERE k=1
 UNION ALL SELECT o.session_id, o.id, o.ts, o.k, (o.ts::DATE <> w.last::DATE OR o.ts - w.last >= INTERVAL 5 MINUTE), CASE WHEN (o.ts::DATE <> w.last::DATE OR o.ts - w.last >= INTERVAL 5 MINUTE) THEN o.ts ELSE w.last END
 FROM w JOIN o ON o.session_id=w.session_id AND o.k=w.k+1)
SELECT w.id, stamped, md5(CASE WHEN stamped THEN strftime(w.ts,'[%m.%d%a %H:%M] ') ELSE '' END || content) AS h FROM w JOIN messages USING (id)""")
def group_stamps(spark, sf):
    return H.group_stamps(A.messages(spark, sf)).select("id", "stamped", F.md5("content").alias("h"))


# the calls of an order are answered in line order: ``done`` counts the calls met so far
REPAIR = """li AS (SELECT l_orderkey AS o, l_linenumber AS l, max(l_partkey) AS p FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1,2),
calls AS (SELECT o, list('c'||o||'_'||l ORDER BY l) AS c FROM li GROUP BY o),
ans AS (SELECT o, l, p, CASE WHEN (o+l)%5=0 THEN NULL WHEN (o+l)%11=0 THEN 'stray' ELSE 'c'||o||'_'||l END AS given, row_number() OVER (PARTITION BY o ORDER BY l) AS i FROM li WHERE (o+l)%7<>0),
walk AS (SELECT o, 0::BIGINT AS i, 0::BIGINT AS done, NULL::BIGINT AS l, NULL::BIGINT AS p, NULL::VARCHAR AS cid FROM calls
 UNION ALL SELECT w.o, a.i, w.done + (w.done < len(c) AND (given IS NULL OR given = c[w.done+1]))::BIGINT, a.l::BIGINT, a.p, CASE WHEN w.done < len(c) AND (given IS NULL OR given = c[w.done+1]) THEN c[w.done+1] END
 FROM walk w JOIN ans a ON a.o=w.o AND a.i=w.i+1 JOIN calls k ON k.o=w.o),
ends AS (SELECT o, max(done) AS done FROM walk GROUP BY 1)"""


@query("reconcile_tools", f"""WITH RECURSIVE {REPAIR}
SELECT o_custkey::VARCHAR AS session_id, o_orderkey*16 AS id, 'assistant' AS role, 'order ' || o_orderkey AS content, NULL::VARCHAR AS tool_call_id, 0::BIGINT AS part, o_orderkey*16 AS "at" FROM orders
UNION ALL SELECT o_custkey::VARCHAR, o*16+l, 'tool', 'part ' || p, cid, 1, o*16+l FROM walk JOIN orders ON o_orderkey=o WHERE cid IS NOT NULL
UNION ALL SELECT o_custkey::VARCHAR, NULL, 'tool', 'PLACEHOLDERx', u, 2, n FROM (SELECT o, unnest(c[done+1:]) AS u, generate_subscripts(c[done+1:],1)-1 AS n FROM calls JOIN ends USING (o)) JOIN orders ON o_orderkey=o""")
def reconcile_tools(spark, sf):
    out = H.reconcile_tools(A.tool_log(spark, sf))
    return out.select("session_id", "id", "role", "content", "tool_call_id", F.col("ord.part").alias("part"), F.col("ord.at").alias("at"))


@query("unique_tool_rows", """WITH li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem), t AS (
 SELECT o_custkey AS s, o*16+l AS id, 'c'||o||'_'||l AS c, CASE WHEN (o+l)%7=0 THEN 'PLACEHOLDERx' ELSE 'x' END AS body FROM li JOIN orders ON o_orderkey=o
 UNION ALL SELECT o_custkey, o*16+l, 'c'||o||'_'||l, 'PLACEHOLDERx' FROM li JOIN orders ON o_orderkey=o WHERE l%2=0),
r AS (SELECT DISTINCT s,c FROM t WHERE body='x') SELECT id, body AS content, count(*) AS n FROM t WHERE body='x' OR NOT EXISTS (SELECT 1 FROM r WHERE r.s=t.s AND r.c=t.c) GROUP BY 1,2""")
def unique_tool_rows(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = li.join(A.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.expr("o_orderkey = l_orderkey")).selectExpr(
        "cast(o_custkey AS string) AS session_id", "l_orderkey * 16 + l_linenumber AS id", "concat('c', l_orderkey, '_', l_linenumber) AS tool_call_id",
        "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'PLACEHOLDERx' ELSE 'x' END AS content", "l_linenumber AS l")
    more = rows.where("l % 2 = 0").withColumn("content", F.lit("PLACEHOLDERx"))
    return H.unique_tool_rows(rows.unionByName(more)).groupBy("id", "content").agg(F.count(F.lit(1)).alias("n"))


_TOK = "CAST(ceil(strlen({0})/4.0) AS BIGINT)"


@query("budget_pack", f"""WITH {MSG}, sy AS (SELECT session_id, id AS ord, role, {_TOK.format('content')} AS t FROM messages WHERE role='system'),
sc AS (SELECT *, sum(t) OVER (PARTITION BY session_id ORDER BY ord) AS u FROM sy), sk AS (SELECT * FROM sc WHERE u <= 200),
su AS (SELECT session_id, max(u) AS su FROM sk GROUP BY 1),
h0 AS (SELECT *, {_TOK.format('content')} AS t, count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT * FROM messages WHERE role IN ('user','tool','assistant') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 4)),
h AS (SELECT h0.*, coalesce(su,0) AS su, sum(t) OVER (PARTITION BY h0.session_id ORDER BY id DESC) AS b FROM h0 LEFT JOIN su ON su.session_id=h0.session_id),
f AS (SELECT * FROM h WHERE su+b <= 200),
st AS (SELECT h.session_id, any_value(h.su) AS su, count(*) AS n, count(*) FILTER (WHERE h.su+h.b<=200) AS m, coalesce(max(h.b) FILTER (WHERE h.su+h.b<=200),0) AS hu FROM h GROUP BY 1),
sm AS (SELECT session_id, max(id) AS sid FROM messages WHERE is_summary GROUP BY 1),
s AS (SELECT st.session_id, m.role, {_TOK.format('m.content')} AS t FROM st JOIN sm USING (session_id) JOIN messages m ON m.id=sm.sid WHERE (st.n=4 OR st.m<st.n) AND st.su+st.hu+{_TOK.format('m.content')} <= 200)
SELECT session_id, 0::BIGINT AS section, ord, role, t AS tokens FROM sk UNION ALL SELECT session_id, 1, 0, role, t FROM s UNION ALL SELECT session_id, 2, id, role, t FROM f""")
def budget_pack(spark, sf):
    m = A.messages(spark, sf)
    system = m.where("role = 'system'").select("session_id", F.col("id").alias("ord"), "role", "content")
    return H.budget_pack(m, system, max_ctx=250, reserve=50, rows=4).select("session_id", "section", "ord", "role", "tokens")


@query("latest_summary", f"WITH {MSG} SELECT session_id, max(id) AS id, md5(arg_max(content,id)) AS h FROM messages WHERE is_summary GROUP BY 1")
def latest_summary(spark, sf):
    return H.latest_summary(A.messages(spark, sf)).select("session_id", "id", F.md5("content").alias("h"))


@query("need_summary", f"""WITH {MSG}, g AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE NOT is_summary) AS plain, arg_max(ts,id) FILTER (WHERE is_summary) AS lt FROM messages GROUP BY 1)
SELECT session_id, total, plain, date_diff('second', lt, TIMESTAMP '2024-01-05 00:00:00')//60 AS age_min, (total>=4 AND (lt IS NULL OR date_diff('second', lt, TIMESTAMP '2024-01-05 00:00:00')//60 >= 30) AND plain>=3) AS due FROM g""")
def need_summary(spark, sf):
    out = H.need_summary(A.messages(spark, sf), F.lit("2024-01-05 00:00:00").cast("timestamp"), 4, 3, 30)
    return out.select("session_id", "total", "plain", F.when(F.col("last_ts").isNotNull(), F.expr("cast(age_min AS long)")).alias("age_min"), F.coalesce("due", F.lit(False)).alias("due"))


@query("summary_input", f"""WITH {MSG}, l AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 5)
SELECT session_id, id AS ord, role, md5(content) AS h FROM l WHERE role<>'system' UNION ALL SELECT session_id, 0, 'system', md5('Previous summary:' || chr(10) || arg_max(content,id)) FROM messages WHERE is_summary GROUP BY 1""")
def summary_input(spark, sf):
    return H.summary_input(A.messages(spark, sf), 5).select("session_id", "ord", "role", F.md5("content").alias("h"))


_TRIG = "trig AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS turn_no FROM messages WHERE role='assistant' AND NOT is_summary QUALIFY turn_no % 2 = 0)"


@query("turn_trigger", f"WITH {MSG}, {_TRIG} SELECT id, session_id, turn_no FROM trig")
def turn_trigger(spark, sf):
    return H.turn_trigger(A.messages(spark, sf), 2).select("id", "session_id", "turn_no")


@query("diary_window", f"""WITH {MSG}, {_TRIG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM messages WHERE role IN ('user','tool','assistant'))
SELECT t.id AS trigger_id, b.id FROM trig t JOIN r a ON a.id=t.id JOIN r b ON b.session_id=a.session_id AND b.n <= a.n AND b.n > a.n-3""")
def diary_window(spark, sf):
    m = A.messages(spark, sf)
    return H.diary_window(m, H.turn_trigger(m, 2), 3).select("trigger_id", "id")
