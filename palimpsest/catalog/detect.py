"""Queries for detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import MSG
from palimpsest.functions import rules as R
from palimpsest.functions import text as X
from palimpsest.operators import detection as D
from palimpsest.plans import adapters as A

TODAY = "2024-03-13"  # a Wednesday

NOTES = """notes AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Please finish "Order ' || o_orderkey%97 || '" by ' || (year(o_orderdate)+30) || strftime(o_orderdate,'-%m-%d') || ' or 3/14.'
 WHEN 1 THEN 'need ' || o_orderkey%50 || 'GB and ' || o_orderkey%7 || '.5 kg in ' || o_orderkey%9 || ' hours; not today'
 WHEN 2 THEN 'Meet John Smith on monday at ' || o_orderkey%12 || 'pm, who knows' WHEN 3 THEN 'I prefer ' || lower(substr(o_orderpriority,3))
 WHEN 4 THEN 'schedule a call next week with Mary Ann Jones' ELSE 'finsh ''Pici'' tmr, don''t wait' END AS text FROM orders)"""
TEXTS = f"{MSG}, {NOTES}, texts AS (SELECT id, text, 'n' AS src FROM notes UNION ALL SELECT id, content, 'm' FROM messages)"
NORM = r"lower(regexp_replace(trim(text),'\s+',' ','g'))"
B, E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def _q(s):
    return s.replace("'", "''")


def any_of(terms, col="l"):
    return "(" + " OR ".join(f"contains({col},'{_q(t)}')" for t in terms) + ")"


def lex(k):
    return any_of([x for t in R.LEXICON[k] for x in [t, *R.TYPOS.get(t, [])]])


NEG = f"regexp_matches(l, '{B}(no|not|don''t|do not|无|不要|别|不|ne\\s+pas|pas{E})')"
CUE = (f"(regexp_matches(l,'{B}\\d{{1,2}}(:\\d{{2}})?\\s*(am|pm){E}') OR regexp_matches(l,'{B}\\d{{1,2}}h(\\d{{2}})?{E}') OR "
       f"regexp_matches(l,'{B}(today|tomorrow|tmrw|tmr|next (week|month)){E}') OR {any_of(['明天', '今天', '下周', '下个月'])})")
QST = f"(contains(l,'?') OR regexp_matches(l,'{B}(who|what|when|where|why|how|qui|quoi|quand|où|pourquoi|comment|谁|什么|什么时候|哪里|为何|如何){E}'))"
IMP = f"regexp_matches(l,'^\\s*(schedule|finish|complete|assign|plan|call|meet|安排|完成|指派|计划|预约|planifier|terminer|attribuer|rendez[-\\s]?vous){E}')"
DUE = f"(regexp_matches(l,'{B}by{E}') OR regexp_matches(l,'{B}之前{E}') OR contains(l,'d''ici') OR regexp_matches(l,'avant{E}'))"
SCORES = f"""flags AS (SELECT id, src, text, {lex('plan')} AS lp, {lex('preference')} AS lf, {lex('assign')} AS la, {lex('schedule')} AS ls, {lex('query')} AS lq,
 {any_of([x for t in R.PREFER_WORDS for x in [t, *R.TYPOS.get(t, [])]])} AS pw, {NEG} AS neg, {CUE} AS cue, {QST} AS qst, {IMP} AS imp, {DUE} AS due FROM (SELECT *, {NORM} AS l FROM texts)),
scores AS (SELECT *, round(lp::INT + 0.7*imp::INT + 0.5*due::INT + 0.1*neg::INT,6)::DOUBLE AS plan, round(lf::INT + 0.7*pw::INT + 0.3*neg::INT,6)::DOUBLE AS preference, round(la::INT + 0.5*imp::INT,6)::DOUBLE AS assign,
 (ls::INT + cue::INT)::DOUBLE AS schedule, (lq::INT + qst::INT)::DOUBLE AS query FROM flags),
labels_ AS (SELECT *, greatest(plan, preference, assign, schedule, query) AS mx FROM scores),
labelled AS (SELECT *, CASE WHEN mx<=0 THEN CASE WHEN qst THEN 'query' ELSE 'other' END WHEN schedule>=plan AND cue THEN 'schedule' WHEN plan=mx THEN 'plan' WHEN preference=mx THEN 'preference'
 WHEN assign=mx THEN 'assign' WHEN schedule=mx THEN 'schedule' ELSE 'query' END AS label FROM labels_)"""


def texts(spark, sf):
    n = A.notes(spark, sf).select("id", "text", F.lit("n").alias("src"))
    return A.spread(n.unionByName(A.messages(spark, sf).select("id", F.col("content").alias("text"), F.lit("m").alias("src"))))


@query("intent_scores", f"WITH {TEXTS}, {SCORES} SELECT id, src, plan, preference, assign, schedule, query FROM scores")
def intent_scores(spark, sf):
    t = texts(spark, sf).withColumn("l", X.detector_norm("text"))
    return t.select("id", "src", *[v.alias(k) for k, v in R.intent_scores("l").items()])


@query("intent_label", f"WITH {TEXTS}, {SCORES} SELECT id, src, label FROM labelled")
def intent_label(spark, sf):
    return texts(spark, sf).withColumn("l", X.detector_norm("text")).select("id", "src", R.intent_label(F.col("l")).alias("label"))


@query("lexicon_match", f"WITH {TEXTS}, {SCORES} SELECT id, src, lp AS plan, lf AS preference, la AS assign, ls AS schedule, lq AS query FROM flags")
def lexicon_match(spark, sf):
    t = texts(spark, sf).withColumn("l", X.detector_norm("text"))
    return t.select("id", "src", *[R.lexicon_match("l", k).alias(k) for k in R.LEXICON])


def _predicate(name, flag, fn):
    @query(name, f"WITH {TEXTS}, {SCORES} SELECT id, src, {flag} AS hit FROM flags")
    def run(spark, sf):
        t = texts(spark, sf).withColumn("l", X.detector_norm("text"))
        return t.select("id", "src", fn("l").alias("hit"))


_predicate("has_negation", "neg", R.has_negation)
_predicate("has_time_cue", "cue", R.has_time_cue)
_predicate("is_question", "qst", R.is_question)
_predicate("looks_imperative", "imp", R.looks_imperative)


_V0 = " ".join(f"WHEN regexp_matches(text,'(?i){p}') THEN '{k}'" for k, p in R.RULES_V0)


@query("intent_rules_v0", f"WITH {NOTES} SELECT id, CASE {_V0} ELSE 'other' END AS label FROM notes")
def intent_rules_v0(spark, sf):
    return A.spread(A.notes(spark, sf)).select("id", R.intent_rules_v0("text").alias("label"))


_NEXT = "CASE lower(left(raw,3)) WHEN 'thu' THEN '2024-03-14' WHEN 'fri' THEN '2024-03-15' WHEN 'sat' THEN '2024-03-16' WHEN 'sun' THEN '2024-03-17' WHEN 'mon' THEN '2024-03-18' WHEN 'tue' THEN '2024-03-19' ELSE '2024-03-20' END"
_WORDDAYS = {"today": "2024-03-13", "tomorrow": "2024-03-14", "tmr": "2024-03-14", "next week": "2024-03-20", "next month": "2024-04-12"}
DATES = (
    r"dates AS (SELECT id, 0 AS k, raw, raw AS iso FROM (SELECT id, unnest(regexp_extract_all(text,'\b(20[2-9]\d-\d{2}-\d{2})\b')) AS raw FROM notes)"
    r" UNION ALL SELECT id, 1, raw, '2024-' || lpad(split_part(raw,'/',1),2,'0') || '-' || lpad(split_part(raw,'/',2),2,'0') FROM (SELECT id, unnest(regexp_extract_all(text,'\b(\d{1,2}/\d{1,2})\b')) AS raw FROM notes)"
    + "".join(rf" UNION ALL SELECT id, 2, regexp_extract(text,'(?i)\b{w}\b'), '{d}' FROM notes WHERE regexp_matches(text,'(?i)\b{w}\b')" for w, d in _WORDDAYS.items())
    + rf" UNION ALL SELECT id, 3, raw, {_NEXT} FROM (SELECT id, regexp_extract(text,'(?i)\b(mon|tue|wed|thu|fri|sat|sun)(day)?\b') AS raw FROM notes) WHERE raw<>'')"
)
QTY = r"qty AS (SELECT id, raw, CAST(regexp_extract(raw,'^[0-9.]+') AS DOUBLE) AS value, lower(regexp_extract(raw,'[A-Za-z]+$')) AS unit FROM (SELECT id, unnest(regexp_extract_all(text,'(?i)\b(\d+(?:\.\d+)?)\s*(kg|g|lb|lbs|gb|mb|ms|s|min|h|hours?)\b')) AS raw FROM notes))"
QUOT = r"""quot AS (SELECT id, trim(m) AS t FROM (SELECT id, unnest(regexp_extract_all(text,'[''"“”](.+?)[''"“”]',1)) AS m FROM notes) WHERE trim(m)<>''
 UNION ALL SELECT id, unnest(regexp_extract_all(text,'\b([A-Z][a-z]+(?:\s+[A-Z][a-z0-9]+){1,4})\b')) FROM notes)"""
PREF = r"pref AS (SELECT id, trim(regexp_extract(text,'(?i)\bprefer(?:s|red)?\s+([^.;,]+)$',1)) AS p FROM notes WHERE regexp_matches(text,'(?i)\bprefer(?:s|red)?\s+([^.;,]+)$'))"
_AT = "strpos(text,{0})-1"


@query("extract_dates", f"WITH {NOTES}, {DATES} SELECT id, raw, iso, strpos(text, raw)-1 AS start FROM dates JOIN notes USING (id)")
def extract_dates(spark, sf):
    d = F.explode(R.extract_dates("text", F.lit(TODAY))).alias("d")
    return A.spread(A.notes(spark, sf)).select("id", d).select("id", "d.raw", "d.iso", "d.start")


@query("extract_quantities", f"WITH {NOTES}, {QTY} SELECT id, raw, value, unit, strpos(text, raw)-1 AS start FROM qty JOIN notes USING (id)")
def extract_quantities(spark, sf):
    return A.spread(A.notes(spark, sf)).select("id", F.explode(R.extract_quantities("text")).alias("q")).select("id", "q.raw", "q.value", "q.unit", "q.start")


@query("extract_quoted_titlecase", f"WITH {NOTES}, {QUOT} SELECT id, t AS text, strpos(text, t)-1 AS start FROM quot JOIN notes USING (id)")
def extract_quoted_titlecase(spark, sf):
    return A.spread(A.notes(spark, sf)).select("id", F.explode(R.extract_quoted_titlecase("text")).alias("m")).select("id", "m.text", "m.start")


@query("extract_preference", f"WITH {NOTES}, {PREF} SELECT id, p AS preference, strpos(text, p)-1 AS start FROM pref JOIN notes USING (id)")
def extract_preference(spark, sf):
    return A.spread(A.notes(spark, sf)).select("id", F.explode(R.extract_preference("text")).alias("p")).select("id", F.col("p.text").alias("preference"), "p.start")


@query("entities_v0", f"""WITH {NOTES}, {DATES}, {QTY}, {QUOT}, {PREF} SELECT id, 'Time' AS type, raw AS text, iso AS norm, 0.8::DOUBLE AS score FROM dates
 UNION ALL SELECT id, 'Quantity', raw, regexp_replace(value::VARCHAR,'\\.0$','') || ' ' || unit, 0.75 FROM qty UNION ALL SELECT id, 'Preference', p, p, 0.8 FROM pref UNION ALL SELECT id, 'Task', t, t, 0.7 FROM quot""")
def entities_v0(spark, sf):
    return D.entity_rows(A.spread(A.notes(spark, sf)).select("id", F.col("text").alias("t0")), R.entities_v0("t0", F.lit(TODAY)), ["id"]).select("id", "type", "text", "norm", "score")


@query("slot_deadline", rf"WITH {NOTES}, {DATES} SELECT n.id, arg_min(iso, k) AS deadline FROM notes n JOIN dates USING (id) WHERE regexp_matches(text,'(?i)\bby\b') GROUP BY 1")
def slot_deadline(spark, sf):
    n = A.spread(A.notes(spark, sf)).withColumn("deadline", R.slot_deadline("text", R.entities_v0("text", F.lit(TODAY))))
    return n.where("deadline IS NOT NULL").select("id", "deadline")


_PT = "CASE event_type WHEN 'click' THEN 'PERSON' WHEN 'error' THEN 'DATE' WHEN 'view' THEN 'PRICE' ELSE upper(event_type) END"


@query("map_entity_type", f"SELECT event_id, CASE {_PT} WHEN 'PERSON' THEN 'Person' WHEN 'DATE' THEN 'Time' WHEN 'PRICE' THEN 'Quantity' ELSE 'Entity' END AS type FROM events")
def map_entity_type(spark, sf):
    return A.table(spark, sf, "events").select("event_id", R.map_entity_type(F.expr(_PT)).alias("type"))


def with_response(spark, sf):
    resp = """concat('{"entities":[{"type":"PERSON","name":"John Smith","salience":0.6,"mentions":[{"text":{"content":"john smith"}},{"text":{"content":"JOHN"}}]},{"type":"DATE","name":"monday","mentions":[{"text":{"content":"monday"}}]},{"type":"ODD","name":"o', id % 3, '","mentions":[{"text":{}}]}]}')"""
    return A.spread(A.notes(spark, sf)).withColumn("resp", F.expr(resp))


@query("mention_entities", f"""WITH {NOTES}, m AS (SELECT id, lower(text) AS t, type, c, norm, score FROM notes, (VALUES ('Person','john smith','John Smith',0.6),('Person','JOHN','John Smith',0.6),('Time','monday','monday',0.5)) v(type,c,norm,score)
 UNION ALL SELECT id, lower(text), 'Entity', 'o' || id%3, 'o' || id%3, 0.5 FROM notes)
SELECT id, type, c AS text, norm, greatest(strpos(t, lower(c))-1,0) AS start, greatest(strpos(t, lower(c))-1,0)+strlen(c) AS "end", score::DOUBLE AS score FROM m""")
def mention_entities(spark, sf):
    rows = with_response(spark, sf).select("id", F.col("text").alias("t0"), "resp")
    return D.entity_rows(rows, R.mention_entities("t0", "resp"), ["id"]).select("id", "type", "text", "norm", "start", "end", "score")


@query("find_spans", "SELECT doc_id, len(regexp_extract_all(lower(text),'ion')) AS n, CASE WHEN strpos(lower(text),'ion')>0 THEN strlen(substr(text,1,strpos(lower(text),'ion')-1)) END AS first_start FROM documents")
def find_spans(spark, sf):
    s = R.find_spans("text", "ION")
    return A.table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", 0)["start"].alias("first_start"))


CATALOG = [
    {"norm": "John", "type": "Person", "variants": ["john smith", "john", "@john"], "word": ("john",)},
    {"norm": "Mary", "type": "Person", "variants": ["mary", "Mary Ann Jones"], "word": ("mary",)},
]


@query("inject_names", f"""WITH {NOTES} SELECT id, 'John' AS norm, 'John Smith' AS text, strpos(text,'John Smith')-1 AS start FROM notes WHERE contains(text,'John Smith')
 UNION ALL SELECT id, 'Mary', 'Mary Ann Jones', strpos(text,'Mary Ann Jones')-1 FROM notes WHERE contains(text,'Mary Ann Jones')""")
def inject_names(spark, sf):
    none = F.array().cast(f"array<{R.ENTITY}>")
    rows = A.spread(A.notes(spark, sf)).select("id", F.col("text").alias("t0"))
    return D.entity_rows(rows, R.inject_names("t0", none, CATALOG), ["id"]).select("id", "norm", "text", "start")


@query("detect", f"""WITH {NOTES}, texts AS (SELECT id, text, 'n' AS src FROM notes), {SCORES}, {PREF}
SELECT l.id, label, 4 + (p IS NOT NULL)::BIGINT AS n_entities, lower(p) AS preference, 'v1' AS version FROM labelled l LEFT JOIN pref USING (id)""")
def detect(spark, sf):
    d = D.detect_texts(with_response(spark, sf), "text", "resp")
    return d.select("id", F.col("det.intent.label").alias("label"), F.size("det.entities").alias("n_entities"), F.col("det.slots")["preference"].alias("preference"), F.col("det.detector_version").alias("version"))


DETS = """dets AS (SELECT o_orderkey AS msg_id, o_custkey::VARCHAR AS session_id, o_orderkey, o_orderdate, c_name, c_mktsegment, ('0.' || (100 + o_orderkey%900))::DECIMAL(8,4) AS iscore, ('0.' || (30 + o_orderkey%60))::DOUBLE AS tscore,
 strftime(o_orderdate,'%Y-%m-%d') AS d FROM orders JOIN customer ON c_custkey=o_custkey),
ents AS (SELECT msg_id, session_id, 0 AS pos, 'Task' AS type, 'Order ' || o_orderkey%97 AS norm, [0, 6 + o_orderkey%3] AS span, tscore AS score FROM dets WHERE tscore >= 0.4
 UNION ALL SELECT msg_id, session_id, (tscore>=0.4)::INT, 'Project', c_mktsegment, [8,12], 0.8 FROM dets UNION ALL SELECT msg_id, session_id, (tscore>=0.4)::INT+1, 'Person', c_name, [13,0], 0.9 FROM dets
 UNION ALL SELECT msg_id, session_id, (tscore>=0.4)::INT+2, 'Time', d, [20,24], 0.8 FROM dets)"""


@query("det_coerce", f"""WITH {DETS} SELECT msg_id, CASE WHEN o_orderkey%5=0 THEN 'other' ELSE 'plan' END AS label, round(iscore,2)::DOUBLE AS score, 3 + (tscore>=0.4)::BIGINT AS n_entities,
 CASE WHEN tscore>=0.4 THEN 'status_hint' ELSE '' END AS task_attrs, CASE WHEN o_orderkey%2=0 THEN 'deadline,priority' ELSE 'priority' END AS slots FROM dets""")
def det_coerce(spark, sf):
    det = R.det_coerce(R.parse_detection("det_json"))
    d = A.detections(spark, sf).withColumn("det", det)
    task = F.get(F.filter("det.entities", lambda e: e["type"] == "Task"), 0)
    return d.select("msg_id", F.col("det.intent.label").alias("label"), F.col("det.intent.score").alias("score"), F.size("det.entities").alias("n_entities"),
                    F.coalesce(F.array_join(F.array_sort(F.map_keys(task["attrs"])), ","), F.lit("")).alias("task_attrs"), F.array_join(F.array_sort(F.map_keys("det.slots")), ",").alias("slots"))


@query("det_valid", "SELECT o_orderkey AS msg_id, o_orderkey%3=0 AS ok FROM orders")
def det_valid(spark, sf):
    raw = F.expr("CASE msg_id % 3 WHEN 0 THEN det_json WHEN 1 THEN '{\"intent\":{},\"entities\":[],\"slots\":{}}' ELSE '[broken' END")
    return A.detections(spark, sf).select("msg_id", F.coalesce(R.det_valid(R.parse_detection(raw)), F.lit(False)).alias("ok"))


@query("evidence_span", f"WITH {DETS} SELECT msg_id, pos::BIGINT AS pos, '{{\"span\":[' || span[1] || ',' || span[2] || ']}}' AS span_json FROM ents")
def evidence_span(spark, sf):
    from palimpsest.operators.linking import evidence_span as span_of
    from palimpsest.plans.kg_build import detection_rows

    return detection_rows(A.detections(spark, sf))[0].select("msg_id", "pos", span_of("span").alias("span_json"))


@query("det_v2_gates", """WITH r AS (SELECT o_orderkey AS msg_id, l_linenumber AS pos, CASE WHEN l_linenumber%2=0 THEN 'Task' ELSE 'Time' END AS type, CASE l_linenumber%4 WHEN 0 THEN 'Pici' ELSE 'Pici hand' END AS norm,
 (l_linenumber*7)%10 AS s, (l_linenumber*7)%10 + 4 AS e, 0.3 + l_discount AS score, o_orderkey%2=0 AS q, max(l_linenumber) AS x FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY ALL),
u AS (SELECT msg_id, pos, type, norm, s, e, max(score) AS score, q FROM r GROUP BY ALL),
k AS (SELECT * FROM u WHERE NOT (type='Task' AND norm='Pici' AND NOT q) AND score >= 0.3999999),
w AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY msg_id,type ORDER BY s,e,pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM k),
i AS (SELECT *, sum(nw) OVER (PARTITION BY msg_id,type ORDER BY s,e,pos) AS g FROM w)
SELECT msg_id, pos, type, norm FROM i QUALIFY row_number() OVER (PARTITION BY msg_id,type,g ORDER BY score DESC, s, pos)=1""")
def det_v2_gates(spark, sf):
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("msg_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_discount").alias("d"))
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS msg_id")
    rows = li.join(o, "msg_id").selectExpr(
        "msg_id", "pos", "CASE WHEN pos % 2 = 0 THEN 'Task' ELSE 'Time' END AS type", "CASE WHEN pos % 4 = 0 THEN 'Pici' ELSE 'Pici hand' END AS norm",
        "(pos * 7) % 10 AS start", "(pos * 7) % 10 + 4 AS end", "round(0.3D + d, 6) AS score", "CASE WHEN msg_id % 2 = 0 THEN \"start 'Pici' now\" ELSE 'start Pici now' END AS source_text")
    return D.det_v2_gates(rows).select("msg_id", "pos", "type", "norm")


@query("det_v2_slots", """SELECT o_orderkey AS msg_id, CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate,'%Y-%m-%d') END AS deadline, strftime(o_orderdate,'%Y-%m-%d') AS date, CAST(NULL AS VARCHAR) AS time_range,
 CASE lower(substr(o_orderpriority,3)) WHEN 'urgent' THEN 'high' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' END AS priority FROM orders""")
def det_v2_slots(spark, sf):
    from palimpsest.plans.kg_build import detection_rows

    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS msg_id", "concat('done', CASE WHEN o_orderkey % 2 = 0 THEN ' by then ' ELSE ' ' END, lower(substr(o_orderpriority, 3))) AS source_text")
    return D.det_v2_slots(detection_rows(A.detections(spark, sf))[0].join(o, "msg_id"))
