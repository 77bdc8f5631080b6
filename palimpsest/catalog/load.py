"""Queries over documents, graph loading and calendars. Documents are built from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import FACTS, TASKS
from palimpsest.functions import hashing as H
from palimpsest.operators import calendar as C
from palimpsest.operators import graph_load as L
from palimpsest.operators.ordered import join_ordered
from palimpsest.plans import adapters as A
from palimpsest.sources import documents as D

BLOCK = 64  # records per built document


def task_docs(spark, sf):
    """One document per 64 orders: a bare array every third time, a byte-order mark every second, broken every seventh."""
    t = A.tasks(spark, sf).withColumn("doc", F.expr(f"seq div {BLOCK}"))
    rec = F.to_json(F.struct("name", "importance", F.struct("date", "start", "end").alias("time"), "updates"))
    body = t.groupBy("doc").agg(join_ordered(rec, ["seq"], ",").alias("b"))
    text = F.expr("CASE WHEN doc % 7 = 6 THEN concat('{\"tasks\":[', b) WHEN doc % 3 = 0 THEN concat('[', b, ']') ELSE concat('{\"tasks\":[', b, ']}') END")
    return body.select("doc", F.when(F.col("doc") % 2 == 0, F.concat(F.lit("﻿"), text)).otherwise(text).alias("text"))


@query("scan_tasks_json", f"WITH {TASKS} SELECT seq//64 AS doc, row_number() OVER (PARTITION BY seq//64 ORDER BY seq)-1 AS pos, name, importance, date, start, array_to_string(updates,';') AS updates FROM tasks WHERE (seq//64)%7<>6")
def scan_tasks_json(spark, sf):
    return D.scan_tasks_json(task_docs(spark, sf), "doc").select("doc", "pos", "name", "importance", "date", "start", F.array_join("updates", ";").alias("updates"))


def fact_docs(spark, sf):
    f = A.facts(spark, sf).withColumn("doc", F.expr(f"pos div {BLOCK}"))
    per = f.groupBy("doc", "key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"])).alias("l"))
    cats = per.groupBy("doc").agg(join_ordered(F.concat(F.lit('"'), "key", F.lit('":'), "l"), ["key"], ",").alias("b"))
    flat = f.groupBy("doc").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"])).alias("e"))
    return cats.join(flat, "doc").select("doc", F.expr("CASE WHEN doc % 4 = 3 THEN concat('{\"entries\":', e, '}') ELSE concat('{\"categories\":{', b, '}}') END").alias("text"))


@query("scan_facts_json", f"WITH {FACTS} SELECT pos//64 AS doc, CASE WHEN (pos//64)%4=3 THEN 'General' ELSE key END AS key, row_number() OVER (PARTITION BY pos//64, CASE WHEN (pos//64)%4=3 THEN '' ELSE key END ORDER BY pos)-1 AS pos, fact FROM facts")
def scan_facts_json(spark, sf):
    return D.scan_facts_json(fact_docs(spark, sf), "doc")


def node_docs(spark, sf):
    c = A.table(spark, sf, "customer").withColumn("doc", F.expr(f"c_custkey div {BLOCK}"))
    rec = F.to_json(F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("title"),
                             F.struct(F.array("c_mktsegment", F.upper("c_name"), F.lower("c_name")).alias("aliases")).alias("attrs_json"),
                             F.round((F.col("c_custkey") % 10) / 10.0, 1).alias("confidence")))
    return c.groupBy("doc").agg(F.concat(F.lit('{"graph_nodes":['), join_ordered(rec, ["c_custkey"], ","), F.lit("]}")).alias("text"))


def edge_docs(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("doc", F.expr(f"o_orderkey div {BLOCK}"))
    rec = F.to_json(F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("n_c"), F.col("o_custkey") + 1).alias("dst_id"),
                             F.col("o_orderstatus").alias("type"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN null ELSE round((o_orderkey % 10) / 10.0D, 1) END").alias("weight")))
    return o.groupBy("doc").agg(F.concat(F.lit('{"graph_edges":['), join_ordered(rec, ["o_orderkey"], ","), F.lit("]}")).alias("text"))


@query("scan_graph_json", "SELECT 'node' AS kind, concat('c',c_custkey) AS id, c_name AS label, round((c_custkey%10)/10.0,1)::DOUBLE AS w, 3::BIGINT AS n FROM customer UNION ALL SELECT 'edge', concat('o',o_orderkey), o_orderstatus, CASE WHEN o_orderkey%4=0 THEN NULL ELSE round((o_orderkey%10)/10.0,1) END, 0 FROM orders")
def scan_graph_json(spark, sf):
    n = D.scan_graph_json(node_docs(spark, sf), "graph_nodes").select(F.lit("node").alias("kind"), "id", F.col("title").alias("label"), F.col("confidence").alias("w"), F.size("aliases").alias("n"))
    e = D.scan_graph_json(edge_docs(spark, sf), "graph_edges").select(F.lit("edge").alias("kind"), "id", F.col("type").alias("label"), F.col("weight").alias("w"), F.lit(0).alias("n"))
    return n.unionByName(e)


def node_lines(spark, sf):
    return A.table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 5 WHEN 4 THEN '' ELSE to_json(named_struct('nid', concat('4:x:', p_partkey), 'labels', array('__Entity__', CASE WHEN p_partkey % 3 = 0 THEN 'Product' ELSE p_type END), "
        "'title', CASE WHEN p_partkey % 5 = 1 THEN null ELSE p_name END, 'props', named_struct('id', p_brand, 'aliases', array(upper(p_name), p_name, ' '), 'aka', array(p_type)))) END AS line", "p_partkey AS line_no")


def edge_lines(spark, sf):
    return A.table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN '{broken' ELSE to_json(named_struct('rid', concat('5:', l_orderkey, ':', l_linenumber), 'type', CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END, "
        "'src', concat('4:x:', l_partkey), 'dst', concat('4:y:', l_suppkey), 'weight', CASE WHEN l_linenumber = 2 THEN l_discount END, 'attrs', map())) END AS line",
        "l_orderkey * 16 + l_linenumber AS line_no")


PART_LINES = "pl AS (SELECT *, '4:x:' || p_partkey AS nid, CASE WHEN p_partkey%5=1 THEN p_brand ELSE p_name END AS title FROM part WHERE p_partkey%5<>4)"
IMP = "'{1}' || upper(substr(sha1({0}),1,26))"


@query("scan_graph_ndjson", f"WITH {PART_LINES} SELECT 'node' AS kind, nid AS id FROM pl UNION ALL SELECT 'edge', '5:' || l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_linenumber<>7")
def scan_graph_ndjson(spark, sf):
    n = D.scan_graph_ndjson(node_lines(spark, sf), "nodes").select(F.lit("node").alias("kind"), F.col("nid").alias("id"))
    return n.unionByName(D.scan_graph_ndjson(edge_lines(spark, sf), "relations").select(F.lit("edge").alias("kind"), F.col("rid").alias("id")))


def norm_id(x, p):
    c = f"(CASE WHEN starts_with({x},'{p}') THEN {x} ELSE '{p}' || {x} END)"
    return f"(CASE WHEN length({c})>=32 THEN substr({c},1,28) || substr(md5({c}),1,4) ELSE {c} || substr(md5({c} || '_pad'),1,32-length({c})) END)"


@query("normalize_id", f"SELECT c_custkey, {norm_id('c_name', 'n_')} AS short, {norm_id('(c_name || c_name)', 'n_')} AS long FROM customer")
def normalize_id(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", H.normalize_id("c_name", "n_").alias("short"), H.normalize_id(F.concat("c_name", "c_name"), "n_").alias("long"))


def alias_id_sql(node, alias):
    w = f"('a_' || regexp_replace({node},'^n_','') || '_' || substr(md5({alias}),1,8))"
    return f"(CASE WHEN length({w})>32 THEN substr({w},1,24) || substr(md5({alias}),1,8) ELSE {norm_id(w, 'a_')} END)"


@query("alias_id", f"SELECT c_custkey, {alias_id_sql(norm_id('c_name', 'n_'), 'c_mktsegment')} AS long, {alias_id_sql('c_mktsegment', 'c_name')} AS short FROM customer")
def alias_id(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", H.alias_id(H.normalize_id("c_name", "n_"), "c_mktsegment").alias("long"), H.alias_id("c_mktsegment", "c_name").alias("short"))


STORED = f"stored AS (SELECT {norm_id(chr(39) + 'c' + chr(39) + ' || c_custkey', 'n_')} AS id, 'Old' AS type, 'old ' || c_name AS title, 0.5::DOUBLE AS confidence, 'promoted' AS status FROM customer WHERE c_acctbal > 0)"
INCOMING = f"inc AS (SELECT {norm_id(chr(39) + 'c' + chr(39) + ' || c_custkey', 'n_')} AS id, c_name, c_mktsegment, round((c_custkey%10)/10.0,1)::DOUBLE AS confidence FROM customer)"
SYNCED = """synced AS (SELECT coalesce(s.id, i.id) AS id, CASE WHEN s.id IS NULL OR i.confidence >= 0.5 THEN 'Person' ELSE 'Old' END AS type, CASE WHEN s.id IS NULL OR i.confidence >= 0.5 THEN c_name ELSE title END AS title,
 CASE WHEN s.id IS NULL OR i.confidence>=0.5 THEN i.confidence ELSE 0.5 END AS confidence, coalesce(status,'provisional') AS status, CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.confidence>=0.5 THEN 'updated' ELSE 'skipped' END AS action FROM inc i LEFT JOIN stored s USING (id))"""


def _stored(spark, sf):
    return A.table(spark, sf, "customer").where("c_acctbal > 0").select(
        H.normalize_id(F.concat(F.lit("c"), "c_custkey"), "n_").alias("id"), F.lit("Old").alias("type"), F.concat(F.lit("old "), "c_name").alias("title"),
        F.lit(0.5).alias("confidence"), F.lit("promoted").alias("status"), F.lit(None).cast("string").alias("attrs_json"))


def _synced(spark, sf):
    inc = D.scan_graph_json(node_docs(spark, sf), "graph_nodes")
    return L.sync_nodes(_stored(spark, sf), inc.withColumn("attrs_json", F.to_json("attrs_json")))


@query("sync_nodes", f"WITH {STORED}, {INCOMING}, {SYNCED} SELECT id, type, title, confidence, status, action FROM synced")
def sync_nodes(spark, sf):
    return _synced(spark, sf).drop("attrs_json")


@query("sync_aliases", f"""WITH {INCOMING}, a AS (SELECT id, confidence, c_mktsegment AS alias, 0 AS pos FROM inc UNION ALL SELECT id, confidence, upper(c_name), 1 FROM inc)
SELECT {alias_id_sql('id', 'alias')} AS id, id AS node_id, alias, confidence AS weight FROM a WHERE NOT (pos=0 AND alias='BUILDING')""")
def sync_aliases(spark, sf):
    inc = D.scan_graph_json(node_docs(spark, sf), "graph_nodes")
    stored = inc.select(H.normalize_id("id", "n_").alias("node_id"), F.lit("building ").alias("alias"), F.lit(L.SYNC_SOURCE).alias("source"))
    return L.sync_aliases(stored, inc).select("id", "node_id", "alias", "weight")


EDGE_IN = f"""ei AS (SELECT o_orderkey, {norm_id(chr(39) + 'o' + chr(39) + ' || o_orderkey', 'e_')} AS id, {norm_id(chr(39) + 'c' + chr(39) + ' || o_custkey', 'n_')} AS src_id, {norm_id(chr(39) + 'n_c' + chr(39) + ' || (o_custkey+1)', 'n_')} AS dst_id, o_orderstatus AS type,
 CASE WHEN o_orderkey%4=0 THEN 0.5 ELSE round((o_orderkey%10)/10.0,1) END::DOUBLE AS weight FROM orders), ok AS (SELECT * FROM ei WHERE src_id IN (SELECT id FROM inc) AND dst_id IN (SELECT id FROM inc)),
es AS (SELECT DISTINCT 'old' || o_custkey AS id, {norm_id(chr(39) + 'c' + chr(39) + ' || o_custkey', 'n_')} AS src_id, {norm_id(chr(39) + 'n_c' + chr(39) + ' || (o_custkey+1)', 'n_')} AS dst_id, 'F' AS type, 0.6::DOUBLE AS weight FROM orders),
nw AS (SELECT src_id, dst_id, type, max(weight) AS weight, arg_min(id, 'o' || o_orderkey) AS first_id FROM ok GROUP BY 1,2,3),
synced_e AS (SELECT coalesce(s.id, first_id) AS id, coalesce(s.src_id, n.src_id) AS src_id, coalesce(s.dst_id,n.dst_id) AS dst_id, coalesce(s.type,n.type) AS type, CASE WHEN s.id IS NULL OR n.weight>=s.weight THEN n.weight ELSE s.weight END AS weight,
 CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.src_id IS NULL THEN 'kept' WHEN n.weight>=s.weight THEN 'updated' ELSE 'skipped' END AS action FROM es s FULL JOIN nw n ON s.src_id=n.src_id AND s.dst_id=n.dst_id AND s.type=n.type)"""


def _edges_synced(spark, sf):
    inc = D.scan_graph_json(edge_docs(spark, sf), "graph_edges").withColumn("attrs_json", F.to_json("attrs_json"))
    stored = A.table(spark, sf, "orders").select(
        F.concat(F.lit("old"), "o_custkey").alias("id"), H.normalize_id(F.concat(F.lit("c"), "o_custkey"), "n_").alias("src_id"),
        H.normalize_id(F.concat(F.lit("n_c"), F.col("o_custkey") + 1), "n_").alias("dst_id"), F.lit("F").alias("type"), F.lit(0.6).alias("weight"), F.lit(None).cast("string").alias("attrs_json")).distinct()
    return L.sync_edges(stored, _synced(spark, sf), inc)


@query("sync_edges", f"WITH {INCOMING}, {EDGE_IN} SELECT id, src_id, dst_id, type, weight, action FROM synced_e")
def sync_edges(spark, sf):
    return _edges_synced(spark, sf)[0].drop("attrs_json")


@query("sync_errors", f"WITH {INCOMING}, {EDGE_IN} SELECT id, src_id, dst_id FROM ei WHERE id NOT IN (SELECT id FROM ok)")
def sync_errors(spark, sf):
    return _edges_synced(spark, sf)[1]


@query("sync_stats", f"WITH {STORED}, {INCOMING}, {SYNCED}, {EDGE_IN} SELECT 'nodes' AS what, action, count(*) AS n FROM synced GROUP BY 2 UNION ALL SELECT 'edges', action, count(*) FROM synced_e GROUP BY 2")
def sync_stats(spark, sf):
    return L.sync_stats(("nodes", _synced(spark, sf)), ("edges", _edges_synced(spark, sf)[0]))


@query("import_id", f"SELECT p_partkey, {IMP.format('p_name', 'n_')} AS id FROM part")
def import_id(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", H.import_id("n_", "p_name").alias("id"))


@query("import_type", f"WITH {PART_LINES} SELECT nid, CASE WHEN p_partkey%3=0 THEN 'Product' ELSE 'Other' END AS type FROM pl")
def import_type(spark, sf):
    return D.scan_graph_ndjson(node_lines(spark, sf), "nodes").select("nid", L.import_type(F.col("labels")).alias("type"))


def _imported(spark, sf):
    return L.import_nodes(D.scan_graph_ndjson(node_lines(spark, sf), "nodes"))


@query("import_nodes", f"""WITH {PART_LINES}, s AS (SELECT DISTINCT {IMP.format("('4:x:' || l_partkey)", 'n_')} AS id FROM lineitem), i AS (SELECT {IMP.format('nid', 'n_')} AS id, CASE WHEN p_partkey%3=0 THEN 'Product' ELSE 'Other' END AS type, title FROM pl)
SELECT coalesce(s.id,i.id) AS id, CASE WHEN s.id IS NOT NULL THEN 'Artifact' ELSE type END AS type, coalesce(title,'old') AS title, CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM s FULL JOIN i ON s.id=i.id""")
def import_nodes(spark, sf):
    stored = A.table(spark, sf, "lineitem").select(H.import_id("n_", F.concat(F.lit("4:x:"), "l_partkey")).alias("id")).distinct().select(
        "id", F.lit("Artifact").alias("type"), F.lit("old").alias("title"), F.lit(0.1).alias("confidence"), F.lit("provisional").alias("status"))
    return L.import_nodes_merge(stored, _imported(spark, sf)).select("id", "type", "title", "action")


@query("import_aliases", f"""WITH {PART_LINES}, a AS (SELECT nid, unnest([upper(p_name), p_name, p_type, p_brand, title]) AS al, unnest([0,1,3,4,5]) AS pos FROM pl)
SELECT node_id, alias, pos, {IMP.format("(node_id || '|' || lower(alias))", 'a_')} AS id FROM (SELECT {IMP.format('nid', 'n_')} AS node_id, arg_max(al, pos) AS alias, min(pos)::BIGINT AS pos FROM a GROUP BY nid, lower(al))""")
def import_aliases(spark, sf):
    return L.import_aliases(_imported(spark, sf)).select("node_id", "alias", "pos", "id")


EDGE_LINES = f"""el AS (SELECT '5:' || l_orderkey || ':' || l_linenumber AS rid, CASE WHEN l_linenumber=1 THEN 'related_to' ELSE l_returnflag END AS type, {IMP.format("('4:x:' || l_partkey)", 'n_')} AS src_id, {IMP.format("('4:y:' || l_suppkey)", 'n_')} AS dst_id, CASE WHEN l_linenumber=2 THEN l_discount ELSE 0.7 END::DOUBLE AS weight FROM lineitem WHERE l_linenumber<>7)"""


@query("import_edges", f"WITH {EDGE_LINES} SELECT rid, {IMP.format(chr(40) + 'src_id || ' + chr(39) + '|' + chr(39) + ' || type || ' + chr(39) + '|' + chr(39) + ' || dst_id' + chr(41), 'e_')} AS id, src_id, dst_id, type, weight FROM el")
def import_edges(spark, sf):
    return L.import_edges(D.scan_graph_ndjson(edge_lines(spark, sf), "relations")).select("rid", "id", "src_id", "dst_id", "type", "weight")


EDGE_ID = IMP.format("(src_id || '|' || type || '|' || dst_id)", "e_")


# the table already holds every third part's relation to its first supplier, under an id of its own
@query("import_edges_merge", f"""WITH {EDGE_LINES}, l AS (SELECT *, CAST(split_part(rid,':',2) AS BIGINT)*16 + CAST(split_part(rid,':',3) AS BIGINT) AS line_no FROM el),
n AS (SELECT src_id, dst_id, type, arg_max(weight, (line_no, {EDGE_ID}, weight)) AS weight FROM l GROUP BY 1,2,3),
s AS (SELECT 'old' || l_partkey AS id, {IMP.format("('4:x:' || l_partkey)", 'n_')} AS src_id, {IMP.format("('4:y:' || min(l_suppkey))", 'n_')} AS dst_id, 'related_to' AS type, 0.1::DOUBLE AS weight FROM lineitem WHERE l_partkey%3=0 GROUP BY l_partkey)
SELECT coalesce(s.id, 'new') AS id, coalesce(n.src_id,s.src_id) AS src_id, coalesce(n.dst_id,s.dst_id) AS dst_id, coalesce(n.type,s.type) AS type, CASE WHEN n.src_id IS NULL THEN s.weight ELSE n.weight END AS weight,
 CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.src_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM n FULL JOIN s ON n.src_id=s.src_id AND n.dst_id=s.dst_id AND n.type=s.type""")
def import_edges_merge(spark, sf):
    first = A.table(spark, sf, "lineitem").where("l_partkey % 3 = 0").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    stored = first.select(
        F.concat(F.lit("old"), "l_partkey").alias("id"), H.import_id("n_", F.concat(F.lit("4:x:"), "l_partkey")).alias("src_id"), H.import_id("n_", F.concat(F.lit("4:y:"), "s")).alias("dst_id"),
        F.lit("related_to").alias("type"), F.lit(0.1).alias("weight"), F.lit("{}").alias("attrs_json"))
    out = L.import_edges_merge(stored, L.import_edges(D.scan_graph_ndjson(edge_lines(spark, sf), "relations")))
    return out.select(F.when(F.col("id").startswith("old"), F.col("id")).otherwise("new").alias("id"), "src_id", "dst_id", "type", "weight", "action")


@query("import_orphans", f"WITH {EDGE_LINES} SELECT DISTINCT {IMP.format(chr(40) + 'src_id || ' + chr(39) + '|' + chr(39) + ' || type || ' + chr(39) + '|' + chr(39) + ' || dst_id' + chr(41), 'e_')} AS id FROM el")
def import_orphans(spark, sf):
    return L.import_orphans(L.import_edges(D.scan_graph_ndjson(edge_lines(spark, sf), "relations")), _imported(spark, sf))


@query("relation_profile", "SELECT CASE WHEN l_linenumber=1 THEN '' ELSE l_returnflag END AS type, count(*) AS n, count(*) FILTER (WHERE l_linenumber=2) AS weighted FROM lineitem WHERE l_linenumber<>7 GROUP BY 1")
def relation_profile(spark, sf):
    return L.relation_profile(D.scan_graph_ndjson(edge_lines(spark, sf), "relations"))


@query("alias_candidates", "SELECT concat('n_c',c_custkey) AS id FROM customer WHERE c_acctbal <= 0")
def alias_candidates(spark, sf):
    n = A.table(spark, sf, "customer").select(F.concat(F.lit("n_c"), "c_custkey").alias("id"), F.lit("Person").alias("type"), F.timestamp_seconds("c_custkey").alias("created_ts"), "c_acctbal")
    t = A.table(spark, sf, "part").select(F.concat(F.lit("n_p"), "p_partkey").alias("id"), F.lit("Task").alias("type"), F.timestamp_seconds("p_partkey").alias("created_ts"), F.lit(0.0).alias("c_acctbal"))
    done = n.where("c_acctbal > 0").select(F.col("id").alias("node_id"), F.lit("assistant").alias("source"))
    return L.alias_candidates(n.union(t), done, limit=None).select("id")


@query("alias_backfill", """WITH c AS (SELECT concat('n_p',p_partkey) AS node_id, unnest([p_name, upper(p_name) || '!', p_brand, '(' || p_brand || ')', '__']) AS alias, unnest([0,1,2,3,4]) AS pos, p_name FROM part),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(alias),'[.,()_]+',' ','g'),'\\s+',' ','g')) AS norm FROM c)
SELECT node_id, alias, greatest(0.5, least(2.0, 1.5-0.01*length(alias)))::DOUBLE AS weight FROM n WHERE norm<>'' AND norm<>p_name QUALIFY row_number() OVER (PARTITION BY node_id, norm ORDER BY pos)=1""")
def alias_backfill(spark, sf):
    p = A.table(spark, sf, "part")
    c = p.select(F.concat(F.lit("n_p"), "p_partkey").alias("node_id"), F.posexplode(F.expr("array(p_name, concat(upper(p_name), '!'), p_brand, concat('(', p_brand, ')'), '__')")).alias("pos", "alias"))
    nodes = p.select(F.concat(F.lit("n_p"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    return L.alias_backfill(c, nodes, A.aliases(spark, sf)).select("node_id", "alias", "weight")


# --- calendars ---------------------------------------------------------------------------------------------
# one calendar per 64 orders; every kind of start the format allows, by order key
ICS = """concat('BEGIN:VEVENT\\r\\nSUMMARY', CASE WHEN k % 3 = 0 THEN ';LANGUAGE=en' ELSE '' END, ':Order\\r\\n  ', k, '\\r\\n', CASE k % 5
 WHEN 0 THEN concat('DTSTART;VALUE=DATE:', d, '\\r\\n') WHEN 1 THEN concat('DTSTART;TZID=\"China Standard Time\":', d, 'T100000\\r\\nDTEND;TZID=\"China Standard Time\":', d, 'T113000\\r\\n')
 WHEN 2 THEN concat('DTSTART:', d, 'T1000Z\\r\\n') WHEN 3 THEN concat('DTSTART:', d, 'T100000\\r\\nDTEND:', d, 'T120000\\r\\n') ELSE 'DTSTART:soon\\r\\n' END, 'END:VEVENT')"""


def feeds(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS k", "date_format(o_orderdate, 'yyyyMMdd') AS d").withColumn("e", F.expr(ICS))
    return o.groupBy(F.expr(f"k div {BLOCK}").alias("feed_id")).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), join_ordered("e", ["k"], "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))


def parsed(spark, sf, now="1998-06-15 02:00:00", until="1998-07-16 02:00:00"):
    t = lambda s: F.lit(s).cast("timestamp")
    return C.ics_events(feeds(spark, sf), t(now) if now else None, t(until) if until else None)


EVS = """evs AS (SELECT o_orderkey AS k, o_orderkey//64 AS feed_id, o_orderdate + CASE o_orderkey%5 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 10 HOUR END AS s,
 o_orderdate + CASE o_orderkey%5 WHEN 0 THEN INTERVAL 24 HOUR WHEN 1 THEN INTERVAL 210 MINUTE WHEN 2 THEN INTERVAL 11 HOUR ELSE INTERVAL 12 HOUR END AS e, 'Order ' || o_orderkey AS summary, o_orderkey%5=0 AS all_day FROM orders WHERE o_orderkey%5<>4)"""
HORIZON = "s < TIMESTAMP '1998-07-16 02:00:00' AND e > TIMESTAMP '1998-06-15 02:00:00'"


@query("scan_ics", f"WITH {EVS} SELECT feed_id, summary, s::VARCHAR AS start, e::VARCHAR AS \"end\", all_day FROM evs")
def scan_ics(spark, sf):
    return parsed(spark, sf, None, None).select("feed_id", "summary", "start", "end", "all_day")


@query("ics_events", f"WITH {EVS} SELECT feed_id, summary, s::VARCHAR AS start, e::VARCHAR AS \"end\", all_day FROM evs WHERE {HORIZON}")
def ics_events(spark, sf):
    return parsed(spark, sf).select("feed_id", "summary", "start", "end", "all_day")


@query("ics_unfold", "SELECT o_orderkey//64 AS feed_id, CAST(sum(CASE o_orderkey%5 WHEN 1 THEN 5 WHEN 3 THEN 5 ELSE 4 END) + 3 AS BIGINT) AS lines FROM orders GROUP BY 1")
def ics_unfold(spark, sf):
    return feeds(spark, sf).select("feed_id", F.size(C.ics_unfold("text")).alias("lines"))


@query("ics_params", "SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, 'x=y' AS eq FROM orders")
def ics_params(spark, sf):
    head = F.expr("concat('DTSTART;S=old;P=', o_orderpriority, ';S=', o_orderstatus, ';E=x=y;junk')")
    o = A.table(spark, sf, "orders").withColumn("m", C.ics_params(head))
    return o.select(F.col("o_orderkey").alias("k"), F.col("m")["P"].alias("p"), F.col("m")["S"].alias("s"), F.col("m")["E"].alias("eq"))


@query("ics_datetime", """SELECT o_orderkey AS k, CASE o_orderkey%4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1 HOUR WHEN 2 THEN o_orderdate + INTERVAL 10 HOUR ELSE o_orderdate + INTERVAL 630 MINUTE END::VARCHAR AS ts, o_orderkey%4=0 AS all_day FROM orders""")
def ics_datetime(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyyMMdd"))
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN d WHEN 1 THEN concat(d, 'T100000') WHEN 2 THEN concat(d, 'T100000Z') ELSE concat(d, 'T1030') END")
    p = F.expr("CASE WHEN o_orderkey % 4 = 1 THEN map('TZID', 'Tokyo Standard Time') ELSE cast(map() AS map<string,string>) END")
    return o.withColumn("x", C.ics_datetime(v, p)).select(F.col("o_orderkey").alias("k"), "x.ts", "x.all_day")


@query("tz_alias", "SELECT o_orderkey AS k, CASE o_orderkey%3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Europe/Oslo' END AS tz FROM orders")
def tz_alias(spark, sf):
    raw = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Eastern Standard Time' WHEN 1 THEN '\"Tokyo Standard Time\"' ELSE 'Europe/Oslo' END")
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.tz_alias(raw).alias("tz"))


@query("feed_tags", "SELECT c_custkey AS k, CASE WHEN c_custkey%2=0 THEN lower(c_mktsegment) || ',x' ELSE 'x,' || lower(c_mktsegment) END AS tags FROM customer")
def feed_tags(spark, sf):
    seg = F.lower("c_mktsegment")
    tag = F.when(F.col("c_custkey") % 2 == 0, seg).otherwise("")
    tags = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("x"), seg, F.lit(""))).otherwise(F.array(F.lit("x"), seg))
    return A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.array_join(C.feed_tags(tag, tags), ",").alias("tags"))


@query("events_to_tasks", f"""WITH {EVS}, n AS (SELECT feed_id AS owner, summary AS name, strftime(o_orderdate,'%Y-%m-%d') AS date, CASE WHEN NOT all_day THEN '10:00' END AS start, CASE k%5 WHEN 1 THEN '11:30' WHEN 2 THEN '11:00' WHEN 3 THEN '12:00' END AS "end"
 FROM evs JOIN orders ON o_orderkey=k WHERE {HORIZON}), s AS (SELECT DISTINCT o_orderkey//64 AS owner, 'Order ' || o_orderkey AS name, strftime(o_orderdate,'%Y-%m-%d') AS date FROM orders WHERE o_orderkey%5=0 AND o_orderkey%2=0)
SELECT coalesce(n.owner,s.owner) AS owner, coalesce(n.name,s.name) AS name, coalesce(n.date,s.date) AS date, n.start, n."end", CASE WHEN s.owner IS NULL THEN 'inserted' WHEN n.owner IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM n FULL JOIN s ON n.owner=s.owner AND n.name=s.name AND n.date=s.date AND n.start IS NULL""")
def events_to_tasks(spark, sf):
    stored = A.table(spark, sf, "orders").where("o_orderkey % 5 = 0 AND o_orderkey % 2 = 0").selectExpr(
        f"o_orderkey div {BLOCK} AS owner", "o_orderkey AS seq", "concat('Order ', o_orderkey) AS name", "'high' AS importance", "cast(null AS array<string>) AS tags",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "cast(null AS string) AS start", "cast(null AS string) AS end", "cast(array() AS array<string>) AS updates")
    out = C.events_to_tasks(stored, parsed(spark, sf), "feed_id", F.col("pos").cast("long"), F.array(F.lit("cal")))
    return out.select("owner", "name", "date", "start", "end", "action")


@query("cal_to_tasks", """SELECT o_custkey AS owner, o_orderkey AS seq, CASE WHEN o_orderkey%7=0 THEN 'Untitled' ELSE 'Order ' || o_orderkey END AS name, 'gcal:' || lower(o_orderstatus) || '_list' AS tags, strftime(o_orderdate,'%Y-%m-%d') AS date,
 CASE WHEN o_orderkey%2=0 THEN '09:15' END AS start, CASE WHEN o_orderkey%4=0 THEN '10:45' END AS "end" FROM orders""")
def cal_to_tasks(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    item = (f"CASE WHEN o_orderkey % 2 = 0 THEN to_json(named_struct('summary', CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat('Order ', o_orderkey) END, 'start', named_struct('dateTime', concat({day}, 'T09:15:00-05:00')), "
            f"'end', named_struct('dateTime', CASE WHEN o_orderkey % 4 = 0 THEN concat({day}, 'T10:45:00-05:00') END))) "
            f"ELSE to_json(named_struct('summary', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Order ', o_orderkey) END, 'start', named_struct('date', {day}), 'end', named_struct('date', {day}))) END AS item_json")
    items = A.table(spark, sf, "orders").selectExpr("o_custkey AS owner", "o_orderkey AS seq", "concat(o_orderstatus, ' List') AS calendar", item)
    return C.cal_to_tasks(items).select("owner", "seq", "name", F.array_join("tags", ",").alias("tags"), "date", "start", "end")


@query("calendar_select", "SELECT c_custkey AS k, CASE WHEN c_custkey%10=0 THEN 'primary' ELSE c_mktsegment END AS name FROM customer WHERE c_mktsegment='BUILDING' OR c_custkey%10=0")
def calendar_select(spark, sf):
    c = A.table(spark, sf, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS summary_override", "c_mktsegment AS summary", "c_custkey % 10 = 0 AS primary")
    return C.calendar_select(c, ["primary", "BUILDING"]).select("k", "name")


@query("parse_local_ts", "SELECT o_orderkey AS k, CASE o_orderkey%4 WHEN 0 THEN o_orderdate - INTERVAL 9 HOUR WHEN 1 THEN o_orderdate + INTERVAL 8 HOUR WHEN 2 THEN o_orderdate + INTERVAL 1 HOUR END::VARCHAR AS ts FROM orders")
def parse_local_ts(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit("T10:00:00+0200"))).when(F.col("o_orderkey") % 4 == 2, F.concat(day, F.lit("T10:00:00"))).otherwise("soon")
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.parse_local_ts(raw, F.lit("Asia/Tokyo")).alias("ts"))


RRULES = "CASE o_orderkey % 6 WHEN 0 THEN 'RRULE:FREQ=DAILY' WHEN 1 THEN 'RRULE:FREQ=WEEKLY' WHEN 2 THEN 'FREQ=WEEKLY;BYDAY=MO,WE' WHEN 3 THEN 'RRULE:FREQ=MONTHLY' WHEN 4 THEN 'FREQ=YEARLY' ELSE 'COUNT=3' END"
SINCE = "DATE '1998-06-15'"
NEXT = f"""a AS (SELECT o_orderkey AS k, o_orderkey%6 AS r, o_orderdate::DATE AS d FROM orders),
months AS (SELECT k, d, 0 AS i FROM a WHERE r=3 UNION ALL SELECT k, ((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE + (day(d)-1)::INT)::DATE, i+1 FROM months WHERE d < {SINCE}),
nxt AS (SELECT a.k, CASE WHEN r=5 THEN NULL WHEN d >= {SINCE} THEN d WHEN r=0 THEN d + ({SINCE} - d)::INT
 WHEN r=1 THEN d + 7*greatest(ceil(({SINCE} - d)/7.0),1)::INT
 WHEN r=2 THEN d + (7*greatest(ceil((({SINCE} - d) - sh)/7.0),1) + sh)::INT WHEN r=3 THEN m ELSE d END AS n
 FROM (SELECT *, CASE isodow(d) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 0 END AS sh FROM a) a LEFT JOIN (SELECT k, max(d) AS m FROM months GROUP BY 1) mm ON mm.k=a.k)"""


@query("rrule_next", f"WITH RECURSIVE {NEXT} SELECT k, strftime(n,'%Y-%m-%d') AS day FROM nxt")
def rrule_next(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("rule", F.expr(RRULES))
    n = C.rrule_next(F.col("rule"), F.col("o_orderdate"), F.lit("1998-06-15").cast("timestamp"), F.lit("UTC"))
    return o.select(F.col("o_orderkey").alias("k"), F.date_format(n, "yyyy-MM-dd").alias("day"))


def payloads(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    rec = (f"to_json(named_struct('id', lower(hex(o_orderkey)), 'title', concat('Order ', o_orderkey % 97), 'status', CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END, "
           f"'dueDate', CASE o_orderkey % 3 WHEN 0 THEN {day} WHEN 1 THEN concat({day}, 'T12:00:00.000+0000') END, 'startDate', CASE WHEN o_orderkey % 3 = 2 THEN {day} END, 'timeZone', 'America/New_York', "
           "'repeatFlag', CASE WHEN o_orderkey % 6 = 0 THEN 'RRULE:FREQ=DAILY' END)) AS rec")
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS owner", rec)
    return o.groupBy("owner", F.expr(f"k div {BLOCK}").alias("seq")).agg(F.concat(F.lit('{"name":"My List","tasks":['), join_ordered("rec", ["k"], ","), F.lit("]}")).alias("payload"))


REMOTE = """rem AS (SELECT o_custkey AS owner, o_orderkey AS k, 'Order ' || o_orderkey%97 AS name, 'remote,remote:my_list' || CASE WHEN o_orderkey%6=0 THEN ',recurring' ELSE '' END AS tags,
 strftime(CASE WHEN o_orderkey%6=0 AND o_orderdate < TIMESTAMP '1998-06-15' THEN TIMESTAMP '1998-06-15' ELSE o_orderdate END, '%Y-%m-%d') AS date, o_orderkey%3=1 AS timed, 'TID=' || lower(to_hex(o_orderkey)) AS updates, o_orderdate,
 lower(to_hex(o_orderkey)) AS tid FROM orders WHERE o_orderkey%5<>0), remk AS (SELECT * FROM rem WHERE date >= '1998-06-15')"""


def _remote(spark, sf):
    return C.remote_tasks(payloads(spark, sf), F.lit("1998-06-15").cast("date"))


@query("remote_tasks", f"WITH {REMOTE} SELECT owner, name, tags, date, timed, updates FROM remk")
def remote_tasks(spark, sf):
    out = _remote(spark, sf)
    return out.select("owner", "name", F.array_join("tags", ",").alias("tags"), "date", F.col("start").isNotNull().alias("timed"), F.array_join("updates", ",").alias("updates"))


@query("extract_tid", "SELECT o_orderkey AS k, CASE WHEN o_orderkey%2=0 THEN lower(to_hex(o_orderkey)) END AS tid FROM orders")
def extract_tid(spark, sf):
    up = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('note', concat(' tid=', hex(o_orderkey)), 'TID=aa') ELSE array('TID=xyz') END")
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.extract_tid(up).alias("tid"))


def local_tasks(spark, sf):
    """The tasks of open orders from the horizon's first two weeks on, already known under their TID."""
    return A.table(spark, sf, "orders").where("o_orderkey % 5 <> 1").selectExpr(
        "o_custkey AS owner", "o_orderkey AS seq", "concat('Local ', o_orderkey) AS name", "'high' AS importance", "cast(null AS array<string>) AS tags", "'2000-01-01' AS date",
        "cast(null AS string) AS start", "cast(null AS string) AS end", "array('mine', concat('TID=', lower(hex(o_orderkey)))) AS updates")


@query("remote_reconcile", f"""WITH {REMOTE}, loc AS (SELECT o_custkey AS owner, o_orderkey AS seq, lower(to_hex(o_orderkey)) AS tid FROM orders WHERE o_orderkey%5<>1)
SELECT l.owner, 'Local ' || seq AS name, 'low' AS importance, 'updated' AS action FROM loc l JOIN remk r ON r.owner=l.owner AND r.tid=l.tid
UNION ALL SELECT owner, name, 'low', 'inserted' FROM (SELECT owner, name, date, timed, CASE WHEN timed THEN strftime(o_orderdate,'%m') END AS mm FROM remk WHERE (owner, tid) NOT IN (SELECT owner, tid FROM loc) GROUP BY owner, name, date, timed, mm)""")
def remote_reconcile(spark, sf):
    inc = _remote(spark, sf).withColumn("seq", F.col("seq") * 1000 + F.col("pos") + 10**12)
    return C.remote_reconcile(local_tasks(spark, sf), inc)[0].select("owner", "name", "importance", "action")


@query("remote_archive", f"WITH {REMOTE} SELECT o_custkey AS owner, o_orderkey AS seq FROM orders WHERE o_orderkey%5<>1 AND (o_custkey, lower(to_hex(o_orderkey))) NOT IN (SELECT owner, tid FROM remk)")
def remote_archive(spark, sf):
    inc = _remote(spark, sf).withColumn("seq", F.col("seq") * 1000 + F.col("pos") + 10**12)
    return C.remote_reconcile(local_tasks(spark, sf), inc)[1].select("owner", "seq")


@query("remote_payload", f"""WITH {TASKS}, t AS (SELECT *, date::DATE + CASE WHEN start IS NULL THEN INTERVAL 9 HOUR ELSE to_hours(substr(start,1,2)::INT) END AS w FROM tasks)
SELECT owner, seq, name AS title, array_to_string(updates,chr(10)) AS content, CASE WHEN date IS NOT NULL THEN strftime(w - INTERVAL 9 HOUR,'%Y-%m-%dT%H:%M:%S') || '+0000' END AS due, CASE importance WHEN 'high' THEN 5 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 END::VARCHAR AS priority FROM t""")
def remote_payload(spark, sf):
    t = A.tasks(spark, sf).withColumn("updates", F.concat("updates", F.array(F.lit("TID=ab")))).withColumn("p", C.remote_payload("proj", tz="Asia/Tokyo"))
    g = lambda k: F.get_json_object("p", f"$.{k}")
    return t.select("owner", "seq", g("title").alias("title"), g("content").alias("content"), g("dueDate").alias("due"), g("priority").alias("priority"))


@query("remote_find", """WITH r AS (SELECT c_custkey AS req_id, 'order ' || c_custkey%97 AS t, CASE WHEN c_custkey%2=0 THEN '1998-0' || (1 + c_custkey%9) ELSE '' END AS d FROM customer),
m AS (SELECT 'order ' || o_orderkey%97 AS t, CASE WHEN o_orderkey%11=0 THEN '' ELSE strftime(o_orderdate,'%Y-%m-%d') END AS due, o_orderkey FROM orders WHERE o_orderkey%5<>0)
SELECT req_id, lower(to_hex(min(o_orderkey))) AS tid FROM r JOIN m ON r.t=m.t AND (d='' OR due='' OR starts_with(due,d)) GROUP BY 1""")
def remote_find(spark, sf):
    req = A.table(spark, sf, "customer").selectExpr("c_custkey AS req_id", "concat(' ORDER ', c_custkey % 97) AS name", "CASE WHEN c_custkey % 2 = 0 THEN concat('1998-0', 1 + c_custkey % 9) END AS date")
    rem = A.table(spark, sf, "orders").selectExpr("concat('Order ', o_orderkey % 97) AS title", "CASE WHEN o_orderkey % 11 = 0 THEN null ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS due_date",
                                                  "CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS status", "o_orderkey AS ord", "lower(hex(o_orderkey)) AS tid")
    return C.remote_find(req, rem)
