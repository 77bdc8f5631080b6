"""Graph golden rows."""

import hashlib

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import graph as G
from palimpsest.operators import graph_load as GL
from palimpsest.sources import embeddings as E
from palimpsest.sources import sinks


def aliases(spark, *rows):
    df = spark.createDataFrame([(f"a{i}", n, a, "s", float(w)) for i, (n, a, w) in enumerate(rows)], "id string, node_id string, alias string, source string, weight double")
    return df.withColumn("alias_key", X.alias_key("alias")).withColumn("created_ts", F.timestamp_seconds(F.substring("id", 2, 5).cast("long")))


def terms(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "term string")


def test_alias_cascade(spark):
    al = aliases(spark, ("n2", "cafe", 1), ("n1", "Café ", 1), ("n3", "big red bus", 0.5), ("n4", "Red", 0.9), ("n5", "a%b", 1))
    best = {r.term: (r.node_id, r.how) for r in G.alias_best(terms(spark, "CAFE", "red car", "ig re", "%", "zz"), al).collect()}
    assert best == {"CAFE": ("n1", "exact"), "red car": ("n4", "search"), "ig re": ("n3", "search"), "%": ("n5", "search")}
    seeds = {r.term: r.node_id for r in G.seeds_readonly(terms(spark, "red", "bus", "re", "caf"), al).collect()}
    assert seeds == {"red": "n4", "bus": "n3", "caf": "n1"}  # newest containing; two characters only match exactly


def pack_of(spark, n_nodes, n_edges):
    nodes = spark.createDataFrame([(1, f"n{i}", i + 1, "T", f"t{i:03d}", 0.5) for i in range(n_nodes)], "query_id long, node_id string, rank int, type string, title string, confidence double")
    edges = spark.createDataFrame([(1, f"e{i}", "n0", f"n{i + 1}", "rel", w) for i, w in zip(range(n_edges), [10.0, 0.7, 0.0] + [0.25] * n_edges)],
                                  "query_id long, id string, src_id string, dst_id string, type string, weight double")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    out = {r.query_id: r.pack for r in G.render_pack(q, nodes, edges, spark.createDataFrame([(1, "n1")], "query_id long, node_id string")).collect()}
    assert out[2] == "[Memory v1]\nSeeds: (none)\nFacts:\nRelations:\nWindow 30d  Nodes 0  Hop 1\n"
    return out[1].split("\n")


def test_pack_at_the_limits(spark):
    lines = pack_of(spark, 60, 30)
    assert lines.count("...") == 1  # the second mark repeats the first and is dropped
    assert sum(x.startswith("- T ") for x in lines) == 60 and sum(x.startswith("  •") for x in lines) == 30
    assert lines[1] == "Seeds: t001" and "  • t000 → t001 (w=10)" in lines and "  • t000 → t002 (w=0.7)" in lines and "  • t000 → t003 (w=0)" in lines
    assert "..." not in pack_of(spark, 59, 29)


def test_adjacent_seeds_are_bridges(spark):
    e = spark.createDataFrame([("1", "a", "b", "t", 0.5), ("2", "b", "c", "t", 0.5), ("3", "x", "y", "t", 0.5)], "id string, src_id string, dst_id string, type string, weight double")
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id long, node_id string")
    assert sorted(r.node_id for r in G.bridge_nodes(s, e, 1).collect()) == ["a", "b"]
    assert sorted(r.node_id for r in G.bridge_nodes(s, e, 2).collect()) == ["a", "b", "c"]


def bridges_by_hand(seeds, edges, k, cap):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for q in {q for q, _ in seeds}:
        own = {s for p, s in seeds if p == q and s is not None}
        counts = {}
        for s in own:
            ball = {s}
            for _ in range(k):
                ball |= {y for x in ball for y in near.get(x, ())}
            for x in ball:
                counts[x] = counts.get(x, 0) + 1
        rows = sorted((-c, x) for x, c in counts.items() if c >= 2)[:cap]
        out |= {(q, x, -c) for c, x in rows} if len(own) >= 2 else set()
    return out


def test_bridges_through_hubs_equal_the_full_walk(spark):
    import random

    rnd = random.Random(5)
    names = [f"n{i:02d}" for i in range(60)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)]
    pairs += [("n00", x) for x in names[20:]] + [(x, "n01") for x in names[30:50]] + [("n00", "n01"), ("n05", "n05"), (None, "n02"), ("n03", None)]
    pairs += pairs[:10]  # repeated edges
    seeds = [(q, rnd.choice(names)) for q in range(8) for _ in range(4)] + [(8, "n00"), (8, "n01"), (8, "n07"), (9, "n00"), (9, "n00"), (10, None), (10, "n04"), (11, "away"), (11, "n06")]
    e = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "src_id string, dst_id string, weight double")
    s = spark.createDataFrame(seeds, "query_id long, node_id string")
    for k, cap, hub in ((1, 100, 6), (2, 7, 6), (2, 100, 0), (2, 100, 1000), (3, 9, 8)):
        got = G.bridge_nodes(s, e, k, cap, hub).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == bridges_by_hand(seeds, pairs, k, cap), (k, cap, hub)
    assert G.bridge_nodes(s.limit(0), e).collect() == [] and G.bridge_nodes(s, e.limit(0)).collect() == []


def test_hub_of_a_third_of_all_edges_is_not_joined_to_each_query(spark):
    leaves, queries = 60_000, 400
    star = spark.range(leaves).selectExpr("'hub' AS src_id", "concat('m', lpad(id, 6, '0')) AS dst_id")
    chain = spark.range(2 * leaves).selectExpr("concat('c', id) AS src_id", "concat('c', id + 1) AS dst_id")
    e = star.union(chain).withColumn("weight", F.lit(0.5))
    s = spark.range(queries).selectExpr("id AS query_id", "explode(array(concat('m', lpad(id, 6, '0')), concat('m', lpad(id + 900, 6, '0')))) AS node_id")
    # joined to each query the walk would be of 2 * 400 * 60,000 rows
    rows = G.bridge_nodes(s, e).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("n_seeds").alias("t"), F.max("node_id").alias("last")).collect()
    assert len(rows) == queries and {(r.n, r.t, r.last) for r in rows} == {(100, 200, "m000098")}


def test_subgraph_drops_dangling_edges_and_stub_scores(spark):
    e = spark.createDataFrame([("1", "a", "b", "t", 0.9), ("2", "a", "gone", "t", 1.0)], "id string, src_id string, dst_id string, type string, weight double")
    n = spark.createDataFrame([("a", "T", "A", 0.5), ("b", "T", "B", 0.5)], "id string, type string, title string, confidence double").withColumn("updated_ts", F.lit(None).cast("timestamp"))
    s = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    nodes, edges = G.subgraph(s, n, e, F.lit("2024-01-01").cast("timestamp"), mode="stub")
    assert [(r.node_id, round(r.score, 6)) for r in nodes.orderBy("rank").collect()] == [("a", 1.51), ("b", 1.51)]
    assert [r.id for r in edges.collect()] == ["1"]


def test_promotion_never_goes_back(spark):
    n = spark.createDataFrame([("a", 0.3, "provisional"), ("b", 0.9, "promoted"), ("c", 0.3, "provisional")], "id string, confidence double, status string")
    u = spark.createDataFrame([("a", 0.8), ("b", 0.1)], "id string, confidence double")
    assert {r.id: (r.confidence, r.status) for r in G.promote_nodes(n, u).collect()} == {"a": (0.8, "promoted"), "b": (0.1, "promoted"), "c": (0.3, "provisional")}


def test_edge_merge_keeps_id_and_is_idempotent(spark):
    old = spark.createDataFrame([("e1", "a", "b", "t", 0.2)], "id string, src_id string, dst_id string, type string, weight double")
    new = spark.createDataFrame([("a", "b", "t", 0.9), ("a", "c", "t", None)], "src_id string, dst_id string, type string, weight double")
    once = sinks.merge_edges(old, new, ["weight"])
    assert sorted((r.dst_id, r.weight, r.action) for r in once.collect()) == [("b", 0.9, "updated"), ("c", 0.7, "inserted")]
    assert once.where("dst_id = 'b'").first().id == "e1"
    twice = sinks.merge_edges(once.select(*old.columns), new, ["weight"])
    assert sorted(map(str, twice.drop("action").collect())) == sorted(map(str, once.drop("action").collect()))


def test_import_alias_spelling_and_place(spark):
    imp = spark.createDataFrame([("n1", ["Bob", " ann", "BOB", ""], 1)], "id string, aliases array<string>, line_no long")
    assert [(r.alias, r.pos) for r in GL.import_aliases(imp).orderBy("pos").collect()] == [("BOB", 0), ("ann", 1)]


def test_sync_last_of_the_strongest(spark):
    full = "n_" + "a" * 30  # already 32 characters: cut and sealed with a hash
    sid = full[:28] + hashlib.md5(full.encode()).hexdigest()[:4]
    stored = spark.createDataFrame([(sid, "T", "old", None, 0.5, "promoted")], "id string, type string, title string, attrs_json string, confidence double, status string")
    inc = spark.createDataFrame([(1, "a" * 30, "T", "weak", None, 0.4), (2, "n_" + "a" * 30, "T", "equal", None, 0.5), (3, "b", "T", "new", None, 0.1)], "o int, id string, type string, title string, attrs_json string, confidence double")
    got = {r.title: (r.status, r.action) for r in GL.sync_nodes(stored, inc, "o").collect()}
    assert got == {"equal": ("promoted", "updated"), "new": ("provisional", "inserted")}


def test_cascade_delete(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "b")], "id string, src_id string, dst_id string")
    al = spark.createDataFrame([("x", "a"), ("y", "b")], "id string, node_id string")
    kept = G.cascade_delete(n, e, al, n.where("id = 'a'"))
    assert [[r.id for r in k.collect()] for k in kept] == [["b"], ["2"], ["y"]]


def test_embedding_blobs(spark):
    import numpy as np

    rows = [("a", 2, "f32", np.array([1, 2], "<f4").tobytes()), ("b", 2, "f16", np.array([0.5, -1], "<f2").tobytes()), ("c", 3, "f32", b"xx"), ("d", 1, "f64", b"12345678")]
    df = spark.createDataFrame([(i, d, t, bytearray(b)) for i, d, t, b in rows], "node_id string, dim int, dtype string, vec_blob binary")
    assert {r.node_id: r.vector for r in E.scan_embeddings(df).collect()} == {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": None, "d": None}


def test_packs_of_equal_seeds_are_walked_once(spark, monkeypatch):
    """Queries that name the same things share a walk; each gets the pack it has alone, also without seeds or without an id."""
    from palimpsest.plans import memory_pack as M

    al = aliases(spark, ("n1", "alpha", 1), ("n2", "beta", 1), ("n3", "gamma", 1))
    nodes = spark.createDataFrame([(f"n{i}", "Project", f"title {i}", 0.5, None) for i in (1, 2, 3, 4)], "id string, type string, title string, confidence double, updated_ts timestamp")
    edges = spark.createDataFrame([(f"e{a}{b}", f"n{a}", f"n{b}", "owns", 0.5) for a, b in ((1, 4), (2, 4), (2, 3))], "id string, src_id string, dst_id string, type string, weight double")
    texts = [(1, "alpha with beta"), (2, "beta, then alpha"), (3, "gamma"), (4, "nothing known"), (5, "nor here"), (6, "alpha beta"), (None, "gamma")]
    queries = spark.createDataFrame(texts, "query_id long, text string")
    now = F.lit("2024-01-01").cast("timestamp")
    seeds = M.memory_seeds(queries, al).cache()
    want = G.render_pack(queries, *G.subgraph(seeds, nodes, edges, now), seeds)
    walked = []
    whole = G.subgraph
    monkeypatch.setattr(G, "subgraph", lambda s, *a, **b: walked.append({r.query_id for r in s.collect()}) or whole(s, *a, **b))
    got = M.memory_pack_batch(queries, nodes, edges, al, now)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    assert walked == [{1, 3, None}]


def test_terms_are_found_in_repeated_keys(spark):
    """Aliases of one key are searched once, and all of them are found."""
    words = ["red lamp", "red lamp", "lamplight", "oil", "Éclair", None, "x"]
    rows = [(f"a{i}", f"n{i}", w, "span", 0.5 + i % 3, w and w.lower().replace("é", "e")) for i, w in enumerate(words * 3)]
    al = spark.createDataFrame(rows, "id string, node_id string, alias string, source string, weight double, alias_key string")
    asked = ["lamp", "il", "ecl", "d l", "x", "none", " "]
    want = sorted((t, r[0]) for t in asked for r in rows if r[5] and t.strip() and t.rstrip() in r[5])
    assert sorted((r.term, r.id) for r in G.containing(terms(spark, *asked), al).collect()) == want
    best = G.containing(terms(spark, *asked), al, 2).groupBy("term", "alias_key").count()
    assert best.where("count > 2").count() == 0 and best.count() == len({(t, rows[int(i[1:])][5]) for t, i in want})


def test_inner_edges_of_repeated_members(spark):
    """Members and edges that come twice give an edge once; loops and edges both ways count."""
    members = spark.createDataFrame([(q, n) for q, ns in {1: "abca", 2: "bcd", 3: "a"}.items() for n in ns], "query_id long, node_id string")
    rows = [("e1", "a", "b", 0.1), ("e1", "a", "b", 0.1), ("e2", "b", "a", 0.2), ("e3", "a", "b", 0.3), ("e4", "c", "c", 0.4), ("e5", "c", "d", 0.5), ("e6", "a", "d", 0.6), ("e7", None, "a", 0.7)]
    edges = spark.createDataFrame(rows, "id string, src_id string, dst_id string, weight double")
    got = sorted((r.query_id, r.id) for r in G._edges_inside(members, edges).collect())
    assert got == [(1, "e1"), (1, "e2"), (1, "e3"), (1, "e4"), (2, "e4"), (2, "e5")]


def test_bridges_make_no_row_for_a_query_a_seed_and_a_node(spark):
    """Queries that share seeds share their walks: what is left on disk does not grow with queries x seeds x nodes (4 million here)."""
    queries, seeds = 100, 20
    first = [(f"s{i}", f"m{i:02d}_{j:02d}") for i in range(seeds) for j in range(100)]
    pairs = first + [(m, f"l{(n * 13 + x * 7) % 9000:04d}") for n, (_, m) in enumerate(first) for x in range(20)]
    e = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "src_id string, dst_id string, weight double")
    asked = [(q, f"s{i}") for q in range(queries) for i in range(seeds)]
    s = spark.createDataFrame(asked, "query_id long, node_id string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.sparkContext._jvm.System.gc()
    size = lambda: sum(f.length() for f in disk.getAllFiles().mkString(",") and [spark.sparkContext._jvm.java.io.File(x) for x in disk.getAllFiles().mkString(",").split(",")])
    before = size()
    rows = {tuple(r) for r in G.bridge_nodes(s, e).collect()}
    assert size() - before < 15e6
    assert {r for r in rows if r[0] in (0, 99)} == bridges_by_hand([x for x in asked if x[0] in (0, 99)], pairs, 2, 100) and len(rows) == 100 * queries


def test_settled_tables_leave_no_shuffle_files_and_are_forgotten(spark):
    import os

    from palimpsest.session import forget, settled

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = set(disk.getAllFiles().mkString(",").split(","))
    df = settled(spark.range(50_000).select((F.col("id") % 7000).alias("k"), F.lit(None).cast("string").alias("none")).groupBy("k", "none").count())
    for _ in range(50):
        new = [f for f in set(disk.getAllFiles().mkString(",").split(",")) - before if "shuffle_" in f]
        if not new:
            break
        __import__("time").sleep(0.2)
    assert not new and df.count() == 7000
    path = df._settled.removeprefix("file:")
    assert os.path.isdir(path)
    forget(df)
    assert not os.path.exists(path)


def test_edges_are_joined_in_turns(spark, monkeypatch):
    """A table of many pairs is joined in turns; edges given twice come once."""
    e = spark.createDataFrame([(f"e{i % 9}", f"n{i % 3}", f"n{i % 3 + 1}", "t", 0.1 * (i % 9)) for i in range(18)], "id string, src_id string, dst_id string, type string, weight double")
    n = spark.createDataFrame([(f"n{i}", "T", f"title {i}", 0.5, None) for i in range(4)], "id string, type string, title string, confidence double, updated_ts timestamp")
    s = spark.createDataFrame([(1, "n1")], "query_id long, node_id string")
    monkeypatch.setattr(G, "TURN_PAIRS", 1)
    nodes, edges = G.subgraph(s, n, e, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.id for r in edges.collect()) == [f"e{i}" for i in range(9) if i % 3 < 2] and nodes.count() == 3
