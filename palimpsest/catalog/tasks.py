"""Queries over tasks, facts and action blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import FACTS, TASKS
from palimpsest.catalog.text import REPLIES_SQL
from palimpsest.operators import actions as AC
from palimpsest.operators import facts as FA
from palimpsest.operators import tasks as T
from palimpsest.plans import adapters as A

TODAY = "1998-06-15"
KEY = "lower(trim(name)) || '|' || coalesce(date,'') || '|' || coalesce(start,'') || '|' || coalesce(\"end\",'')"

# requests: one per customer, by name; even customers also give a date
REQ = """req AS (SELECT c_custkey AS req_id, c_custkey AS owner, ' ORDER ' || (c_custkey%97) AS name, CASE WHEN c_custkey%2=0 THEN '1998-0' || (1 + c_custkey%9) || '-15' END AS date FROM customer
 UNION ALL SELECT 1000000000 + o_orderkey, o_custkey, 'order ' || o_orderkey%97, CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate,'%Y-%m-%d') END FROM orders)"""


def requests(spark, sf):
    c = A.table(spark, sf, "customer").selectExpr("c_custkey AS req_id", "c_custkey AS owner", "concat(' ORDER ', c_custkey % 97) AS name", "CASE WHEN c_custkey % 2 = 0 THEN concat('1998-0', 1 + c_custkey % 9, '-15') END AS date")
    o = A.table(spark, sf, "orders").selectExpr("1000000000 + o_orderkey AS req_id", "o_custkey AS owner", "concat('order ', o_orderkey % 97) AS name", "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS date")
    return c.union(o).withColumn("start", F.lit(None).cast("string")).withColumn("end", F.lit(None).cast("string")).withColumn("note", F.concat(F.lit("note "), (F.col("req_id") % 3).cast("string")))


JOINED = "hits AS (SELECT r.req_id, r.owner, t.seq, t.name, t.date, t.start FROM req r JOIN tasks t ON t.owner=r.owner AND lower(t.name)=lower(trim(r.name)) AND (r.date IS NULL OR coalesce(t.date,'')=r.date)), best AS (SELECT req_id, owner, min(seq) AS seq FROM hits GROUP BY 1,2)"


@query("task_normalize", f"WITH {TASKS} SELECT owner, seq, name, date, start, CASE WHEN seq%2=0 THEN 's' ELSE 's,t' END AS updates FROM tasks")
def task_normalize(spark, sf):
    t = A.tasks(spark, sf).withColumn("start", F.coalesce("start", F.lit(""))).withColumn("updates", F.when(F.col("seq") % 2 == 0, F.array(F.lit("s"), F.lit("s"))).otherwise(F.array(F.lit("s"), F.lit("t"), F.lit("s"))))
    return T.task_normalize(t).select("owner", "seq", "name", "date", "start", F.array_join("updates", ",").alias("updates"))


@query("task_key", f"WITH {TASKS} SELECT owner, seq, {KEY} AS key FROM tasks")
def task_key(spark, sf):
    return A.tasks(spark, sf).select("owner", "seq", T.task_key().alias("key"))


# the stored table holds the tasks before 1998, the batch the rest
@query("task_upsert", f"""WITH {TASKS}, k AS (SELECT *, {KEY} AS key, o_orderdate >= TIMESTAMP '1998-01-01' AS new FROM tasks JOIN orders ON o_orderkey=seq),
f AS (SELECT owner, key, min(seq) AS first_old FROM k WHERE NOT new GROUP BY 1,2),
u AS (SELECT k.*, first_old FROM k LEFT JOIN f USING (owner,key)),
n AS (SELECT owner, key, upd, min((new, seq)) AS p FROM (SELECT owner, key, new, seq, unnest(updates) AS upd FROM u WHERE new OR seq=first_old) GROUP BY 1,2,3),
nl AS (SELECT owner, key, string_agg(upd, ';' ORDER BY p) AS updates FROM n GROUP BY 1,2)
SELECT owner, arg_min(seq, (new,seq)) AS seq, arg_max(importance, (new,seq)) AS importance, nl.updates AS updates, CASE WHEN min(new) THEN 'inserted' WHEN max(new) THEN 'updated' ELSE 'kept' END AS action
FROM u JOIN nl USING (owner,key) WHERE new OR seq=first_old GROUP BY owner, key, nl.updates
UNION ALL SELECT owner, seq, importance, array_to_string(updates,';'), 'kept' FROM u WHERE NOT new AND seq>first_old""")
def task_upsert(spark, sf):
    t = A.tasks(spark, sf).join(A.table(spark, sf, "orders").selectExpr("o_orderkey AS seq", "o_orderdate"), "seq")
    out = T.task_upsert(t.where("o_orderdate < '1998-01-01'"), t.where("o_orderdate >= '1998-01-01'"))
    return out.select("owner", "seq", "importance", F.array_join("updates", ";").alias("updates"), "action")


@query("task_list", f"WITH {TASKS} SELECT owner, count(*) AS n, min(seq) AS first_seq FROM tasks GROUP BY 1")
def task_list(spark, sf):
    return A.tasks(spark, sf).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("task_find", f"WITH {TASKS}, {REQ}, {JOINED} SELECT req_id, owner, seq FROM best")
def task_find(spark, sf):
    return T.task_find(A.tasks(spark, sf), requests(spark, sf)).select("req_id", "owner", "seq")


@query("task_match_loose", f"WITH {TASKS}, {REQ} SELECT req_id, r.owner, min(seq) AS seq FROM req r JOIN tasks t ON t.owner=r.owner AND lower(t.name)=lower(trim(r.name)) AND (r.date IS NULL OR t.date IS NULL OR t.date=r.date) GROUP BY 1,2")
def task_match_loose(spark, sf):
    return T.task_find(A.tasks(spark, sf), requests(spark, sf), loose=True).select("req_id", "owner", "seq")


@query("task_append_update", f"""WITH {TASKS}, {REQ}, {JOINED}, l AS (SELECT owner, seq, 'note ' || req_id%3 AS note, min(req_id) AS o FROM best GROUP BY 1,2,3), a AS (SELECT owner, seq, string_agg(note,';' ORDER BY o) AS notes FROM l GROUP BY 1,2)
SELECT t.owner, t.seq, array_to_string(updates,';') || coalesce(';' || notes,'') AS updates FROM tasks t LEFT JOIN a USING (owner, seq)""")
def task_append_update(spark, sf):
    return T.task_append_update(A.tasks(spark, sf), requests(spark, sf)).select("owner", "seq", F.array_join("updates", ";").alias("updates"))


@query("task_delete", f"WITH {TASKS}, {REQ}, {JOINED} SELECT owner, seq FROM tasks WHERE (owner, seq) NOT IN (SELECT owner, seq FROM hits)")
def task_delete(spark, sf):
    return T.task_delete(A.tasks(spark, sf), requests(spark, sf)).select("owner", "seq")


FIN = f"""{TASKS}, {REQ}, rr AS (SELECT *, row_number() OVER (PARTITION BY owner, lower(trim(name)), date ORDER BY req_id) AS nth FROM req),
hh AS (SELECT owner, lname, date, seq, row_number() OVER (PARTITION BY owner, lname, date ORDER BY seq) AS nth FROM (SELECT DISTINCT r.owner, lower(trim(r.name)) AS lname, r.date, t.seq FROM req r JOIN tasks t ON t.owner=r.owner AND lower(t.name)=lower(trim(r.name)) AND (r.date IS NULL OR coalesce(t.date,'')=r.date))),
done AS (SELECT hh.owner, seq, min(req_id) AS req_id FROM rr JOIN hh ON rr.owner=hh.owner AND lower(trim(rr.name))=lname AND rr.nth=hh.nth AND rr.date IS NOT DISTINCT FROM hh.date GROUP BY 1,2)"""


@query("task_finish", f"WITH {FIN} SELECT owner, seq, req_id FROM done")
def task_finish(spark, sf):
    return T.task_finish(A.tasks(spark, sf), requests(spark, sf))[1].select("owner", "seq", "req_id")


@query("task_pop", f"WITH {FIN} SELECT owner, seq FROM tasks WHERE (owner, seq) NOT IN (SELECT owner, seq FROM done)")
def task_pop(spark, sf):
    return T.task_finish(A.tasks(spark, sf), requests(spark, sf))[0].select("owner", "seq")


@query("task_sort", f"WITH {TASKS} SELECT owner, seq, row_number() OVER (PARTITION BY owner ORDER BY date IS NULL, date, CASE WHEN date IS NULL THEN '' ELSE coalesce(start,'00:00') END, seq) AS place FROM tasks")
def task_sort(spark, sf):
    return T.with_sort(A.tasks(spark, sf)).select("owner", "seq", "place")


BUCKET = f"CASE WHEN date < '{TODAY}' THEN 'past' WHEN date <= '1998-06-30' THEN 'present' ELSE 'future' END"


@query("task_buckets", f"WITH {TASKS} SELECT owner, seq, {BUCKET} AS bucket FROM tasks")
def task_buckets(spark, sf):
    return A.tasks(spark, sf).select("owner", "seq", T.task_bucket(TODAY).alias("bucket"))


def _digest_sql(caps, full, wrap):
    return f"""WITH {TASKS}, b AS (SELECT *, {BUCKET} AS bucket FROM tasks),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, bucket ORDER BY coalesce(date,'~'), CASE WHEN date IS NULL THEN '' ELSE coalesce(start,'00:00') END, seq) AS p FROM b),
c AS (SELECT * FROM r WHERE p <= CASE bucket WHEN 'past' THEN {caps[0]} WHEN 'present' THEN {caps[1]} ELSE {caps[2]} END),
l AS (SELECT owner, bucket, string_agg('- ' || CASE WHEN bucket='present' THEN {full} || ' Updates: ' || array_to_string(updates,'; ') ELSE name END, chr(10) ORDER BY p) AS t FROM c GROUP BY 1,2),
w AS (SELECT owner, max(t) FILTER (WHERE bucket='past') AS pa, max(t) FILTER (WHERE bucket='present') AS pr, max(t) FILTER (WHERE bucket='future') AS fu FROM l GROUP BY 1)
SELECT owner, {wrap[0]} || concat_ws(chr(10), 'Past:' || chr(10) || pa, CASE WHEN pa IS NOT NULL THEN chr(10) ELSE '' END || 'Present (next 15 days):' || chr(10) || pr, CASE WHEN pr IS NOT NULL THEN chr(10) ELSE '' END || 'Future:' || chr(10) || fu) || '```' AS digest FROM w"""


@query("task_digest", _digest_sql((8, 45, 20), "'[' || date || coalesce(' ' || start,'') || strftime(date::DATE,' (%a)') || '] (' || importance || ') ' || name", [f"'{T.POLICY}' || chr(10) || '```'"]))
def task_digest(spark, sf):
    return T.task_digest(A.tasks(spark, sf), TODAY)


@query("task_digest_v1", _digest_sql((8, 10, 8), "'[' || importance || '] ' || name || ' - ' || date || coalesce(' ' || start,'')", [f"'```{T.POLICY}' || chr(10)"]))
def task_digest_v1(spark, sf):
    return T.task_digest(A.tasks(spark, sf), TODAY, style="v1")


# --- facts -------------------------------------------------------------------------------------------------
@query("facts_list", f"WITH {FACTS} SELECT owner, key, fact, min(pos) AS pos, lower(key) AS key_order FROM facts GROUP BY 1,2,3")
def facts_list(spark, sf):
    return FA.facts_list(A.facts(spark, sf))


@query("facts_remember", f"""WITH {FACTS}, n AS (SELECT c_custkey AS owner, 'error' AS key, 'k' || c_custkey%100 AS fact, c_custkey AS pos FROM customer),
s AS (SELECT *, 0 AS g FROM facts UNION ALL SELECT *, 1 FROM n) SELECT owner, key, fact, arg_min(pos,(g,pos)) AS pos, min(g)=1 AS added FROM s GROUP BY 1,2,3""")
def facts_remember(spark, sf):
    n = A.table(spark, sf, "customer").selectExpr("c_custkey AS owner", "'error' AS key", "concat('  k', c_custkey % 100) AS fact", "c_custkey AS pos")
    return FA.facts_remember(A.facts(spark, sf), n)


@query("facts_forget", f"WITH {FACTS} SELECT owner, key, fact, pos FROM facts WHERE fact <> 'k' || owner%100 AND NOT (key='click' AND fact = 'k' || (owner+1)%100)")
def facts_forget(spark, sf):
    c = A.table(spark, sf, "events").selectExpr("user_id AS owner").distinct()
    gone = c.selectExpr("owner", "'*' AS key", "concat('k', owner % 100) AS fact").union(c.selectExpr("owner", "'click'", "concat('k', (owner + 1) % 100)"))
    return FA.facts_forget(A.facts(spark, sf), gone)


@query("facts_render", f"""WITH {FACTS}, u AS (SELECT owner, key, fact, min(pos) AS p FROM facts GROUP BY 1,2,3), k AS (SELECT owner, key, string_agg(fact,'; ' ORDER BY p) AS b FROM u GROUP BY 1,2),
l AS (SELECT owner, 'memories: keys=' || string_agg(key,',' ORDER BY key) || ' | ' || string_agg(key || '[' || b || ']', ' | ' ORDER BY key) AS line FROM k GROUP BY 1)
SELECT c_custkey AS owner, md5(coalesce(line,'memories: none')) AS h FROM customer LEFT JOIN l ON owner=c_custkey""")
def facts_render(spark, sf):
    owners = A.table(spark, sf, "customer").selectExpr("c_custkey AS owner")
    return FA.facts_render(A.facts(spark, sf), owners).select("owner", F.md5("line").alias("h"))


@query("facts_render_legacy", f"WITH {FACTS} SELECT owner, md5('memories: ' || string_agg(fact,' | ' ORDER BY pos)) AS h FROM facts GROUP BY 1")
def facts_render_legacy(spark, sf):
    return FA.facts_render_legacy(A.facts(spark, sf)).select("owner", F.md5("line").alias("h"))


# --- action blocks -----------------------------------------------------------------------------------------
FENCES = rf"""{REPLIES_SQL}, raw AS (SELECT id, owner, unnest(ts) AS tag0, unnest(ps) AS p0, generate_subscripts(ts,1)-1 AS pos FROM (SELECT id, owner, regexp_extract_all(text,'~~~(\w+)\s*(\{{[\s\S]*?\}})\s*~~~',1) AS ts, regexp_extract_all(text,'~~~(\w+)\s*(\{{[\s\S]*?\}})\s*~~~',2) AS ps FROM replies)),
fixed AS (SELECT id, owner, pos, lower(tag0) AS tag, CASE WHEN json_valid(p0) AND NOT regexp_matches(p0,',\s*[}}\]]') THEN p0 WHEN json_valid(regexp_replace(p0,',\s*([}}\]])','\1','g')) THEN regexp_replace(p0,',\s*([}}\]])','\1','g') END AS payload FROM raw)"""


@query("fence_extract", f"WITH {FENCES} SELECT id, pos, tag, payload, payload IS NOT NULL AS ok FROM fixed")
def fence_extract(spark, sf):
    return AC.fence_extract(A.reply_texts(spark, sf))


@query("tool_calls_extract", """WITH li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem)
SELECT o*16 AS id, row_number() OVER (PARTITION BY o ORDER BY l)-1 AS pos, 'c'||o||'_'||l AS call_id, 'action' AS fn, '{}' AS args, CAST(NULL AS VARCHAR) AS error FROM li JOIN orders ON o_orderkey=o""")
def tool_calls_extract(spark, sf):
    return AC.tool_calls_extract(A.tool_log(spark, sf).where("role = 'assistant'"))


CLASSED = """cls AS (SELECT id, pos, tag, payload IS NOT NULL AND tag IN ('action','memory','interest','debug') AS handled, CASE WHEN payload IS NULL THEN 'invalid_json' WHEN tag IN ('action','memory') THEN 'executed' WHEN tag IN ('interest','debug') THEN 'for_server_execute' ELSE 'reserved' END AS status FROM fixed)"""


def classed(spark, sf):
    f = AC.fence_extract(A.reply_texts(spark, sf))
    err = F.when(~F.col("ok"), "invalid_json")
    return f.withColumn("c", AC.action_classify(F.col("tag"), err, F.lit(False))).select("id", "pos", "tag", "c.handled", "c.status")


@query("action_classify", f"WITH {FENCES}, {CLASSED} SELECT id, pos, tag, handled, status FROM cls")
def action_classify(spark, sf):
    return classed(spark, sf)


@query("route_counts", f"WITH {FENCES}, {CLASSED} SELECT id, count(*) FILTER (WHERE handled) AS handled, count(*) FILTER (WHERE NOT handled) AS unhandled FROM cls GROUP BY 1")
def route_counts(spark, sf):
    return AC.route_counts(classed(spark, sf))


def _payloads(spark, sf, tag):
    return AC.fence_extract(A.reply_texts(spark, sf), keep=["owner"]).where((F.col("tag") == tag) & F.col("ok"))


# one name's actions in order, one step of the recursion for each; no action of the input names a start or an end
@query("actions_apply", f"""WITH RECURSIVE {FENCES}, {TASKS},
acts AS (SELECT owner, id, lower(trim(j->>'$.args.name')) AS lname, j->>'$.intent' AS intent, trim(j->>'$.args.name') AS name, j->>'$.args.date' AS date, j->>'$.args.importance' AS imp, j->>'$.args.updates[0]' AS upd,
 row_number() OVER (PARTITION BY owner, lower(trim(j->>'$.args.name')) ORDER BY id) AS k FROM (SELECT *, CAST(payload AS JSON) AS j FROM fixed WHERE tag='action' AND payload IS NOT NULL)),
st AS (SELECT owner, lower(name) AS lname, list({{'seq': seq, 'name': name, 'importance': importance, 'date': date, 'start': start, 'updates': updates}} ORDER BY seq) AS ts FROM tasks GROUP BY 1, 2),
heads AS (SELECT owner, lname, ts FROM st UNION ALL SELECT DISTINCT owner, lname, CAST([] AS STRUCT(seq BIGINT, name VARCHAR, importance VARCHAR, date VARCHAR, start VARCHAR, updates VARCHAR[])[]) FROM acts ANTI JOIN st USING (owner, lname)),
fold AS (
 SELECT owner, lname, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS intent, NULL::VARCHAR AS status, ts[0] AS hit, ts FROM heads
 UNION ALL
 SELECT owner, lname, k, id, intent,
  CASE intent WHEN 'create_task' THEN CASE WHEN ix > 0 THEN 'updated' ELSE 'inserted' END WHEN 'update_task' THEN CASE WHEN len(ts) > 0 THEN 'updated' ELSE 'not_found' END
   WHEN 'delete_task' THEN CASE WHEN len(gone) > 0 THEN 'deleted' ELSE 'not_found' END ELSE CASE WHEN len(ts) > 0 THEN 'finished' ELSE 'not_found' END END,
  CASE intent WHEN 'create_task' THEN made WHEN 'update_task' THEN noted WHEN 'delete_task' THEN gone[1] ELSE ts[1] END,
  CASE intent WHEN 'create_task' THEN CASE WHEN ix > 0 THEN ts[:ix-1] || [{{'seq': ts[ix].seq, 'name': made.name, 'importance': made.importance, 'date': made.date, 'start': ts[ix].start, 'updates': ts[ix].updates}}] || ts[ix+1:] ELSE ts || [made] END
   WHEN 'update_task' THEN CASE WHEN len(ts) > 0 THEN [noted] || ts[2:] ELSE ts END
   WHEN 'delete_task' THEN list_filter(ts, lambda t: coalesce(t.date, '') <> date) ELSE ts[2:] END
 FROM (SELECT f.owner, f.lname, a.k, a.id, a.intent, a.date, f.ts, list_filter(f.ts, lambda t: coalesce(t.date, '') = a.date) AS gone,
   coalesce(list_position(list_transform(f.ts, lambda t: coalesce(t.date, '') || '|' || coalesce(t.start, '')), a.date || '|'), 0) AS ix,
   {{'seq': a.id, 'name': a.name, 'importance': a.imp, 'date': a.date, 'start': NULL::VARCHAR, 'updates': []::VARCHAR[]}} AS made,
   CASE WHEN len(f.ts) > 0 THEN {{'seq': f.ts[1].seq, 'name': f.ts[1].name, 'importance': f.ts[1].importance, 'date': f.ts[1].date, 'start': f.ts[1].start,
    'updates': CASE WHEN list_contains(f.ts[1].updates, a.upd) THEN f.ts[1].updates ELSE list_append(f.ts[1].updates, a.upd) END}} END AS noted
  FROM fold f JOIN acts a ON a.owner=f.owner AND a.lname=f.lname AND a.k=f.k+1)),
ends AS (SELECT owner, unnest(arg_max(ts, k)) AS t FROM fold GROUP BY owner, lname),
shown AS (SELECT 'task' AS kind, NULL::BIGINT AS "at", NULL::VARCHAR AS intent, NULL::VARCHAR AS status, owner, t FROM ends
 UNION ALL SELECT 'result', id, intent, status, owner, CASE WHEN status <> 'not_found' THEN hit END FROM fold WHERE k > 0
 UNION ALL SELECT 'archived', id, intent, status, owner, hit FROM fold WHERE status = 'finished')
SELECT kind, "at", intent, status, owner, t.seq AS seq, t.name AS name, t.importance AS importance, t.date AS date, t.start AS start, array_to_string(t.updates, ';') AS updates FROM shown""")
def actions_apply(spark, sf):
    acts = _payloads(spark, sf, "action").select("owner", F.col("id").alias("at"), "payload")
    out = AC.actions_apply(A.tasks(spark, sf), acts)
    return out.select("kind", "at", "intent", "status", "owner", "seq", "name", "importance", "date", "start", F.array_join("updates", ";").alias("updates"))


MEM = f"""{FENCES}, m AS (SELECT owner, id AS t_at, json_extract_string(payload,'$.op') AS op, json_extract_string(payload,'$.key') AS key, json_extract_string(payload,'$.fact') AS fact FROM fixed WHERE tag='memory')"""


@query("facts_apply", f"""WITH {MEM}, st AS (SELECT DISTINCT o_custkey AS owner, 'K' || o_custkey%3 AS key, 'likes ' || o_custkey%13 AS fact FROM orders),
w AS (SELECT owner, key, fact, -1 AS t_at FROM st UNION ALL SELECT owner, key, fact, t_at FROM m WHERE op='upsert'),
d AS (SELECT w.*, (SELECT max(t_at) FROM m WHERE op='delete' AND m.owner=w.owner AND m.fact=w.fact AND m.key IN ('*', w.key)) AS cut FROM w)
SELECT owner, key, fact, min(t_at) AS pos FROM d WHERE cut IS NULL OR t_at > cut GROUP BY 1,2,3""")
def facts_apply(spark, sf):
    ops = _payloads(spark, sf, "memory").select("owner", F.col("id").alias("at"), *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("op", "key", "fact")])
    store = A.table(spark, sf, "orders").selectExpr("o_custkey AS owner", "concat('K', o_custkey % 3) AS key", "concat('likes ', o_custkey % 13) AS fact", "-1L AS pos").distinct()
    return FA.facts_apply(store, ops)[0].drop("gen")


@query("interest_extract", f"""WITH {REPLIES_SQL}, o AS (SELECT o_orderkey AS id, lower(substr(o_orderpriority,3)) AS imp FROM orders)
SELECT r.id, CASE WHEN r.id%18=2 THEN 'x,y' WHEN r.id%18=3 THEN 'z' ELSE imp || ',b,c,d' END AS topics, CASE WHEN r.id%18=2 THEN 'call' WHEN r.id%18=3 THEN 'router' ELSE 'r' || r.id%4 END AS reason,
 CASE WHEN r.id%18=2 THEN 0.9 WHEN r.id%18=3 THEN 0.5 WHEN r.id%2=0 THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence FROM replies r JOIN o USING (id) WHERE r.id%9=6 OR r.id%18 IN (2,3)""")
def interest_extract(spark, sf):
    calls = F.expr("CASE WHEN id % 18 = 2 THEN '[{\"type\":\"function\",\"function\":{\"name\":\"Interest\",\"arguments\":\"{\\\\\"topics\\\\\":[\\\\\"x\\\\\",\\\\\"y\\\\\"],\\\\\"reason\\\\\":\\\\\"call\\\\\",\\\\\"confidence\\\\\":0.9}\"}}]' END")
    router = F.expr("CASE WHEN id % 18 = 3 THEN '{\"handled\":[{\"tag\":\"action\"},{\"tag\":\"interest\",\"payload\":{\"topics\":[\"z\"],\"reason\":\"router\",\"confidence\":0.5}}]}' END")
    rows = A.reply_texts(spark, sf).withColumn("tool_calls_json", calls).withColumn("router_json", router)
    return AC.interest_extract(rows).select("id", F.array_join("topics", ",").alias("topics"), "reason", "confidence")
