"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.sqlbase import ALIASES, EDGES, EVIDENCE, NODES
from palimpsest.operators import graph as G
from palimpsest.operators.merge import upsert  # noqa: F401
from palimpsest.plans import adapters as A
from palimpsest.sources import sinks

# terms: whole titles, words of part names, pieces of customer names, and one that matches nothing
TERMS = """terms AS (SELECT DISTINCT term FROM (SELECT upper(n_name) || ' ' AS term FROM nation UNION ALL SELECT unnest(string_split(p_name,' ')) FROM part
 UNION ALL SELECT substr(c_name,12,7) FROM customer UNION ALL SELECT 'idge%' ))"""
KEYED = "kt AS (SELECT term, lower(trim(strip_accents(term))) AS k FROM terms)"
EXACT = "ex AS (SELECT term, node_id, alias, weight FROM kt JOIN aliases ON alias_key=k QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, node_id, id)=1)"


def search(limit):
    return rf"""tok AS (SELECT id, node_id, alias, weight, unnest(list_distinct(regexp_extract_all(alias_key,'\w+'))) AS w FROM aliases),
tt AS (SELECT term, unnest(list_distinct(regexp_extract_all(k,'\w+'))) AS w FROM kt),
wh AS (SELECT DISTINCT term, id, node_id, alias, weight FROM tt JOIN tok USING (w)),
sh AS (SELECT term, id, node_id, alias, weight FROM kt JOIN aliases ON contains(alias_key, k) WHERE term NOT IN (SELECT term FROM wh)),
se AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, node_id, id) AS rank FROM (SELECT * FROM wh UNION ALL SELECT * FROM sh) QUALIFY rank <= {limit})"""


def terms(spark, sf):
    t = lambda n: A.table(spark, sf, n)
    whole = t("nation").selectExpr("concat(upper(n_name), ' ') AS term")
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("term"))
    piece = t("customer").selectExpr("substr(c_name, 12, 7) AS term")
    return whole.union(words).union(piece).union(t("region").selectExpr("'idge%' AS term")).distinct()


@query("embeddings_info", "SELECT concat('n_p',vec_id) AS node_id, p_name AS title, 64::BIGINT AS dim, 'f32' AS dtype, 256::BIGINT AS bytes FROM embeddings JOIN part ON p_partkey=vec_id")
def embeddings_info(spark, sf):
    from palimpsest.sources import embeddings as E

    blobs = E.encode_vectors(A.vectors(spark, sf).withColumn("node_id", F.expr("concat('n_p', id)")), "vector")
    return E.embeddings_info(blobs, A.stored(A.nodes(spark, sf)))


@query("scan_embeddings", "SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])),5) AS total FROM embeddings")
def scan_embeddings(spark, sf):
    from palimpsest.sources import embeddings as E

    out = E.scan_embeddings(E.encode_vectors(A.vectors(spark, sf), "vector"))
    return out.select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("alias_exact", f"WITH {ALIASES}, {TERMS}, {KEYED}, {EXACT} SELECT term, node_id, alias, weight FROM ex")
def alias_exact(spark, sf):
    return G.alias_exact(terms(spark, sf), A.stored(A.aliases(spark, sf))).select("term", "node_id", "alias", "weight")


@query("alias_search", f"WITH {ALIASES}, {TERMS}, {KEYED}, {search(5)} SELECT term, rank, node_id, alias, weight FROM se")
def alias_search(spark, sf):
    return G.alias_search(terms(spark, sf), A.stored(A.aliases(spark, sf)), 5).select("term", "rank", "node_id", "alias", "weight")


@query("alias_best", f"WITH {ALIASES}, {TERMS}, {KEYED}, {EXACT}, {search(1)} SELECT term, node_id, 'exact' AS how FROM ex UNION ALL SELECT term, node_id, 'search' FROM se WHERE term NOT IN (SELECT term FROM ex)")
def alias_best(spark, sf):
    return G.alias_best(terms(spark, sf), A.stored(A.aliases(spark, sf))).select("term", "node_id", "how")


@query("seeds_readonly", f"""WITH {ALIASES}, {TERMS}, {KEYED}, {EXACT},
ct AS (SELECT term, node_id FROM kt JOIN aliases ON contains(alias_key,k) WHERE length(term)>=3 AND term NOT IN (SELECT term FROM ex) QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(alias) DESC, id)=1)
SELECT term, node_id FROM ex UNION ALL SELECT * FROM ct""")
def seeds_readonly(spark, sf):
    return G.seeds_readonly(terms(spark, sf), A.stored(A.aliases(spark, sf)))


QTEXT = "qt AS (SELECT p_partkey AS query_id, concat('about the ', s_name, ' and ', p_name, ' in NATION_', s_nationkey) AS text FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) ON l_partkey=p_partkey JOIN supplier ON s_suppkey=sk)"


def query_texts(spark, sf):
    s, p = A.table(spark, sf, "supplier"), A.table(spark, sf, "part")
    sold = A.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("sk"))
    return p.join(sold, F.expr("l_partkey = p_partkey")).join(s, F.expr("s_suppkey = sk")).selectExpr("p_partkey AS query_id", "concat('about the ', s_name, ' and ', p_name, ' in NATION_', s_nationkey) AS text")


_STOPS = "['the','a','an','and','or','to','of','in','is','are','was','were','on','for','with','at','by','it','this','that']"


def text_seeds(limit=3):
    return f"""{QTEXT}, qtok AS (SELECT DISTINCT query_id, w AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(text),'[a-z0-9_]+')) AS w FROM qt) WHERE length(w)>=2 AND NOT list_contains({_STOPS}, w)),
terms AS (SELECT DISTINCT term FROM qtok), {KEYED}, {EXACT}, {search(limit)},
tseeds AS (SELECT DISTINCT query_id, node_id FROM qtok JOIN (SELECT term, node_id FROM ex UNION ALL SELECT term, node_id FROM se WHERE term NOT IN (SELECT term FROM ex)) USING (term))"""


@query("seeds_from_text", f"WITH {ALIASES}, {text_seeds()} SELECT query_id, node_id FROM tseeds")
def seeds_from_text(spark, sf):
    return G.seeds_from_text(query_texts(spark, sf), A.stored(A.aliases(spark, sf)))


@query("nodes_by_ids", f"WITH {NODES} SELECT id, type, title FROM nodes WHERE id IN (SELECT concat('n_p',l_partkey) FROM lineitem WHERE l_quantity > 45)")
def nodes_by_ids(spark, sf):
    ids = A.table(spark, sf, "lineitem").where("l_quantity > 45").selectExpr("concat('n_p', l_partkey) AS id")
    return G.nodes_by_ids(A.stored(A.nodes(spark, sf)), ids).select("id", "type", "title")


@query("edges_touching", f"WITH {EDGES} SELECT id, src_id, dst_id FROM edges WHERE src_id IN (SELECT concat('n_c',c_custkey) FROM customer WHERE c_acctbal<0) OR dst_id IN (SELECT concat('n_n',n_nationkey) FROM nation WHERE n_regionkey=1)")
def edges_touching(spark, sf):
    ids = A.table(spark, sf, "customer").where("c_acctbal < 0").selectExpr("concat('n_c', c_custkey) AS id").union(
        A.table(spark, sf, "nation").where("n_regionkey = 1").selectExpr("concat('n_n', n_nationkey) AS id"))
    return G.edges_touching(A.stored(A.edges(spark, sf)), ids).select("id", "src_id", "dst_id")


@query("edge_dedupe", "SELECT concat('n_c',o_custkey) AS src_id, arg_max(o_orderstatus, o_orderkey) AS type, max(o_orderkey) AS ord FROM orders GROUP BY o_custkey")
def edge_dedupe(spark, sf):
    e = A.table(spark, sf, "orders").selectExpr("concat('e', o_custkey) AS id", "concat('n_c', o_custkey) AS src_id", "'x' AS dst_id", "o_orderstatus AS type", "o_orderkey AS ord")
    return G.edge_dedupe(e, "ord").select("src_id", "type", "ord")


SEEDS = "seeds AS (SELECT s_suppkey AS query_id, concat('n_s',s_suppkey) AS node_id FROM supplier UNION SELECT s_suppkey, concat('n_c',s_suppkey) FROM supplier)"
ADJ = "adj AS (SELECT src_id AS a, dst_id AS b, weight FROM edges UNION ALL SELECT dst_id, src_id, weight FROM edges)"


def seeds(spark, sf):
    s = A.table(spark, sf, "supplier")
    return s.selectExpr("s_suppkey AS query_id", "concat('n_s', s_suppkey) AS node_id").union(s.selectExpr("s_suppkey", "concat('n_c', s_suppkey)"))


def level(n, prev, visited, cap):
    return f"""l{n} AS (SELECT f.query_id, b AS node_id, max(weight) AS w FROM {prev} f JOIN adj ON a=f.node_id WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.query_id=f.query_id AND v.node_id=b) GROUP BY 1,2
 QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY max(weight) DESC, b) <= {cap})"""


@query("khop_expand", f"""WITH {EDGES}, {ADJ}, {SEEDS}, {level(1, 'seeds', 'seeds', 500)}, v1 AS (SELECT query_id, node_id FROM seeds UNION ALL SELECT query_id, node_id FROM l1), {level(2, 'l1', 'v1', 500)}
SELECT query_id, node_id, 0::BIGINT AS depth FROM seeds UNION ALL SELECT query_id, node_id, 1 FROM l1 UNION ALL SELECT query_id, node_id, 2 FROM l2""")
def khop_expand(spark, sf):
    return G.khop_expand(seeds(spark, sf), A.stored(A.edges(spark, sf)), 2)


BRIDGES = """adj0 AS (SELECT DISTINCT a, b FROM adj), r1 AS (SELECT DISTINCT query_id, node_id AS seed, b AS node_id FROM seeds JOIN adj0 ON a=node_id),
r2 AS (SELECT DISTINCT query_id, seed, b AS node_id FROM r1 JOIN adj0 ON a=node_id),
ra AS (SELECT query_id, node_id AS seed, node_id FROM seeds UNION SELECT * FROM r1 UNION SELECT * FROM r2),
br AS (SELECT query_id, node_id, count(*) AS n_seeds FROM ra GROUP BY 1,2 HAVING count(*)>=2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, node_id) <= 100)"""


@query("bridge_nodes", f"WITH {EDGES}, {ADJ}, {SEEDS}, {BRIDGES} SELECT query_id, node_id, n_seeds FROM br")
def bridge_nodes(spark, sf):
    return G.bridge_nodes(seeds(spark, sf), A.stored_edges(spark, sf))


@query("rank_score", f"WITH {NODES} SELECT id, round(1.0*confidence + 0.6/(1.0+coalesce(date_diff('hour', updated_ts, TIMESTAMP '2002-01-01 00:00:00'),999)/24.0), 6) AS score FROM nodes")
def rank_score(spark, sf):
    hours = F.expr("(unix_timestamp(timestamp'2002-01-01 00:00:00') - unix_timestamp(updated_ts)) / 3600")
    none = F.lit(None).cast("double")
    return A.stored(A.nodes(spark, sf)).select("id", F.round(G.rank_score(F.col("confidence"), hours, none, none), 6).alias("score"))


def sub(seed_cte):
    return f"""{seed_cte}, {ADJ}, {level(1, 'seeds', 'seeds', 500)}, {BRIDGES},
mem0 AS (SELECT query_id, node_id FROM seeds UNION SELECT query_id, node_id FROM l1 UNION SELECT query_id, node_id FROM br),
mem AS (SELECT m.query_id, n.* FROM mem0 m JOIN nodes n ON n.id=m.node_id),
inn AS (SELECT s.query_id, e.* FROM edges e JOIN mem s ON s.id=e.src_id JOIN mem d ON d.id=e.dst_id AND d.query_id=s.query_id),
st AS (SELECT query_id, id, max(weight) AS edge, count(*) AS deg FROM (SELECT query_id, src_id AS id, weight FROM inn UNION ALL SELECT query_id, dst_id, weight FROM inn) GROUP BY 1,2),
mx AS (SELECT query_id, max(deg) AS md FROM st GROUP BY 1),
kept AS (SELECT query_id, mem.id AS node_id, type, title, confidence, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem.id) AS rank FROM (
  SELECT mem.*, round(1.0 + 0.6/(1.0 + CASE WHEN updated_ts IS NULL THEN 999.0 ELSE greatest(date_diff('second', updated_ts, TIMESTAMP '2002-01-01 00:00:00')/3600.0, 0) END/24.0) + 0.5*coalesce(edge,0) + 0.2*coalesce(deg/md::DOUBLE,0), 9) AS score
  FROM mem LEFT JOIN st ON st.query_id=mem.query_id AND st.id=mem.id LEFT JOIN mx ON mx.query_id=mem.query_id) mem QUALIFY rank <= 100),
ked AS (SELECT inn.* FROM inn JOIN kept s ON s.query_id=inn.query_id AND s.node_id=src_id JOIN kept d ON d.query_id=inn.query_id AND d.node_id=dst_id)"""




def _now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


def sub_of(spark, sf, s):
    return G.subgraph(s, A.nodes(spark, sf), A.stored_edges(spark, sf), _now())


@query("subgraph", f"WITH {NODES}, {EDGES}, {sub(SEEDS)} SELECT query_id, node_id, rank, round(score,6) AS score FROM kept")
def subgraph(spark, sf):
    return sub_of(spark, sf, seeds(spark, sf))[0].select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


@query("subgraph_edges", f"WITH {NODES}, {EDGES}, {sub(SEEDS)} SELECT query_id, id, src_id, dst_id, type FROM ked")
def subgraph_edges(spark, sf):
    return sub_of(spark, sf, seeds(spark, sf))[1].select("query_id", "id", "src_id", "dst_id", "type")


PACK = r"""sl AS (SELECT query_id, string_agg(title,'; ' ORDER BY rank) AS t FROM kept WHERE (query_id, node_id) IN (SELECT query_id, node_id FROM seeds) GROUP BY 1),
rel AS (SELECT ked.query_id, ked.type, ked.weight, ked.id, s.title AS st, d.title AS dt, row_number() OVER (PARTITION BY ked.query_id ORDER BY ked.type, ked.weight DESC, s.title, d.title, ked.id) AS r
 FROM ked JOIN kept s ON s.query_id=ked.query_id AND s.node_id=src_id JOIN kept d ON d.query_id=ked.query_id AND d.node_id=dst_id QUALIFY r <= 30),
ln AS (SELECT query_id, 0 AS s, 0 AS i, 0 AS j, '[Memory v1]' AS line FROM qs UNION ALL SELECT query_id, 0, 1, 0, 'Seeds: ' || coalesce(t,'(none)') FROM qs LEFT JOIN sl USING (query_id)
 UNION ALL SELECT query_id, 1, 0, 0, 'Facts:' FROM qs UNION ALL SELECT query_id, 2, rank, 1, printf('- %s %s (conf=%.2f)', type, title, confidence) FROM kept WHERE rank<=60
 UNION ALL SELECT query_id, 2, 61, 1, '...' FROM kept WHERE rank=60 UNION ALL SELECT query_id, 3, 0, 0, 'Relations:' FROM qs
 UNION ALL SELECT query_id, 4, min(r), 0, '- ' || type || ':' FROM rel GROUP BY query_id, type
 UNION ALL SELECT query_id, 4, r, 1, '  • ' || st || ' → ' || dt || ' (w=' || regexp_replace(regexp_replace(printf('%.2f', weight),'0+$',''),'\.$','') || ')' FROM rel
 UNION ALL SELECT query_id, 5, 0, 0, '...' FROM rel WHERE r=30
 UNION ALL SELECT query_id, 6, 0, 0, printf('Window 30d  Nodes %d  Hop 1', coalesce(c,0)) FROM qs LEFT JOIN (SELECT query_id, count(*) AS c FROM kept GROUP BY 1) USING (query_id)),
once AS (SELECT query_id, line, min((s,i,j)) AS o FROM ln GROUP BY 1,2),
packs AS (SELECT query_id, string_agg(line, chr(10) ORDER BY o) || chr(10) AS pack FROM once GROUP BY 1)"""


@query("render_pack", f"WITH {NODES}, {EDGES}, {sub(SEEDS)}, qs AS (SELECT DISTINCT query_id FROM seeds), {PACK} SELECT query_id, pack FROM packs")
def render_pack(spark, sf):
    s = seeds(spark, sf)
    n, e = sub_of(spark, sf, s)
    return G.render_pack(s, n, e, s)


NEW_EDGES = """SELECT concat('n_c',c_custkey) AS src_id, concat('n_n',c_nationkey) AS dst_id, 'member_of' AS type, 0.9::DOUBLE AS weight FROM customer WHERE c_acctbal>0
 UNION ALL SELECT concat('n_c',c_custkey), concat('n_n',c_nationkey), 'owns', NULL FROM customer"""
UPSERT = f"""WITH {EDGES}, nw AS ({NEW_EDGES}) SELECT coalesce(e.src_id,nw.src_id) AS src_id, coalesce(e.dst_id,nw.dst_id) AS dst_id, coalesce(e.type,nw.type) AS type,
 CASE WHEN nw.src_id IS NOT NULL THEN coalesce(nw.weight,0.7) ELSE e.weight END AS weight, CASE WHEN e.src_id IS NULL THEN 'inserted' WHEN nw.src_id IS NULL THEN 'kept' ELSE 'updated' END AS action, e.id IS NOT NULL AS had_id
 FROM edges e FULL JOIN nw ON e.src_id=nw.src_id AND e.dst_id=nw.dst_id AND e.type=nw.type"""


@query("edge_upsert", UPSERT)
def edge_upsert(spark, sf):
    c = A.table(spark, sf, "customer")
    a = c.where("c_acctbal > 0").selectExpr("concat('n_c', c_custkey) AS src_id", "concat('n_n', c_nationkey) AS dst_id", "'member_of' AS type", "0.9D AS weight")
    b = c.selectExpr("concat('n_c', c_custkey) AS src_id", "concat('n_n', c_nationkey) AS dst_id", "'owns' AS type", "cast(null AS double) AS weight")
    out = sinks.merge_edges(A.stored(A.edges(spark, sf)), a.union(b), ["weight"])
    stored = F.expr("concat('e_', substr(md5(concat_ws('|', src_id, type, dst_id)), 1, 26))")
    return out.select("src_id", "dst_id", "type", "weight", "action", (F.col("id") == stored).alias("had_id"))


@query("sink_graph", f"WITH {NODES} SELECT id, type, title FROM nodes UNION ALL SELECT DISTINCT concat('n_b',p_brand), 'Other', p_brand FROM part")
def sink_graph(spark, sf):
    new = A.table(spark, sf, "part").selectExpr("concat('n_b', p_brand) AS id", "'Other' AS type", "p_brand AS title")
    stored = A.stored(A.nodes(spark, sf)).select("id", "type", "title")
    return sinks.append_rows(stored, new.union(stored))


@query("promote_nodes", f"WITH {NODES}, u AS (SELECT concat('n_c',o_custkey) AS id, max(o_totalprice)/500000.0 AS c FROM orders GROUP BY 1) SELECT id, round(coalesce(c,confidence),6) AS confidence, CASE WHEN c>=0.8 THEN 'promoted' ELSE status END AS status FROM nodes LEFT JOIN u USING (id)")
def promote_nodes(spark, sf):
    u = A.table(spark, sf, "orders").selectExpr("concat('n_c', o_custkey) AS id", "o_totalprice / 500000.0D AS confidence")
    return G.promote_nodes(A.stored(A.nodes(spark, sf)), u).select("id", F.round("confidence", 6).alias("confidence"), "status")


@query("repeat_evidence", f"WITH {NODES}, {EVIDENCE} SELECT id, count(DISTINCT msg_id) AS n, 0.8::DOUBLE AS confidence FROM nodes JOIN (SELECT subject_id, msg_id FROM evidence) ON subject_id=id WHERE status='provisional' GROUP BY 1 HAVING n>=3")
def repeat_evidence(spark, sf):
    return G.repeat_evidence(A.stored(A.nodes(spark, sf)), A.evidence(spark, sf))


@query("evidence_add", f"WITH {EVIDENCE} SELECT id, subject_id, msg_id FROM evidence UNION ALL SELECT DISTINCT concat('x_',l_orderkey,'_',l_partkey), concat('n_p',l_partkey), l_orderkey FROM lineitem")
def evidence_add(spark, sf):
    new = A.table(spark, sf, "lineitem").selectExpr("concat('x_', l_orderkey, '_', l_partkey) AS id", "concat('n_p', l_partkey) AS subject_id", "l_orderkey AS msg_id")
    return sinks.append_rows(A.evidence(spark, sf).select("id", "subject_id", "msg_id"), new)


@query("evidence_for_message", f"WITH {EVIDENCE} SELECT msg_id, subject_id, row_number() OVER (PARTITION BY msg_id ORDER BY created_ts DESC, id) AS place FROM evidence")
def evidence_for_message(spark, sf):
    ev = A.evidence(spark, sf)
    return G.evidence_for_message(ev, ev).select("msg_id", "subject_id", "place")


@query("nodes_by_alias", f"WITH {ALIASES}, {TERMS}, {KEYED} SELECT DISTINCT term, n.id, n.title FROM kt JOIN aliases ON alias_key=k JOIN nodes n ON n.id=node_id")
def nodes_by_alias(spark, sf):
    return G.nodes_by_alias(A.stored(A.nodes(spark, sf)), A.stored(A.aliases(spark, sf)), terms(spark, sf)).select("term", "id", "title")


@query("assigned_tasks", f"WITH {NODES}, {EDGES} SELECT src_id, n.id, n.title FROM edges e JOIN nodes n ON n.id=e.dst_id WHERE e.type='related_to' AND src_id IN (SELECT id FROM nodes WHERE type='Person')")
def assigned_tasks(spark, sf):
    n = A.stored(A.nodes(spark, sf))
    return G.assigned_tasks(n, A.stored(A.edges(spark, sf)), n.where("type = 'Person'"), "related_to").select("src_id", "id", "title")


@query("schema_validate", f"""WITH {NODES}, {EDGES} SELECT 'node' AS kind, id, 'type ' || type AS problem FROM nodes WHERE type<>'Person' UNION ALL SELECT 'edge', id, 'type ' || type FROM edges WHERE type NOT IN ('member_of','related_to')
 UNION ALL SELECT 'node', id, 'attr ' || unnest(CASE type WHEN 'Person' THEN ['shoe'] ELSE ['email','shoe'] END) FROM nodes""")
def schema_validate(spark, sf):
    n = A.stored(A.nodes(spark, sf)).withColumn("attrs", F.expr("map('email', 'x', 'shoe', '42')"))
    return G.schema_validate(n, A.stored(A.edges(spark, sf)), "attrs")


@query("graph_integrity", f"""WITH {NODES}, {EDGES}, {EVIDENCE}, good AS (SELECT id FROM nodes WHERE confidence > 0.5), al AS (SELECT concat('a',id) AS id, id AS node_id FROM nodes)
SELECT 'edge_src' AS problem, id FROM edges WHERE src_id NOT IN (SELECT id FROM good) UNION ALL SELECT 'edge_dst', id FROM edges WHERE dst_id NOT IN (SELECT id FROM good)
UNION ALL SELECT 'alias_node', id FROM al WHERE node_id NOT IN (SELECT id FROM good) UNION ALL SELECT 'evidence_node', id FROM evidence WHERE subject_id NOT IN (SELECT id FROM good)
UNION ALL SELECT 'edge_repeated', max(id) FROM edges GROUP BY src_id, dst_id, type HAVING count(*)>1""")
def graph_integrity(spark, sf):
    n = A.stored(A.nodes(spark, sf))
    al = n.select(F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("node_id"))
    return G.graph_integrity(n.where("confidence > 0.5"), A.stored(A.edges(spark, sf)), al, A.evidence(spark, sf))


@query("ttl_prune", f"WITH {NODES} SELECT id FROM nodes WHERE NOT (status='provisional' AND coalesce(date_diff('second', updated_ts, TIMESTAMP '2001-09-01 00:00:00')//86400 > 90, false))")
def ttl_prune(spark, sf):
    e = A.stored(A.edges(spark, sf)).withColumn("updated_ts", F.lit(None).cast("timestamp"))
    return G.ttl_prune(A.stored(A.nodes(spark, sf)), e, F.lit("2001-09-01").cast("timestamp"))[0].select("id")
