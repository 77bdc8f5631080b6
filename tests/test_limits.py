"""Values beyond former limits, repeated keys, and letters beyond ASCII."""

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import actions as AC
from palimpsest.operators import calendar as CA
from palimpsest.operators import chunks as C
from palimpsest.operators import facts as FA
from palimpsest.operators import graph_load as GL
from palimpsest.operators.merge import upsert
from palimpsest.sources import documents as D


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_function_results_have_one_rule(spark):
    deep = "{" * 12 + "x" + "}" * 12
    cases = {
        f"a function result: {deep} b": "a function result: [result] b",
        f'function  result: {{"a":1}} and function result: {deep}': 'function  result: {"a":1} and function result: [result]',
        "function result: {open and function result: {\"b\":{}} end": "function result: {open and function result: [result] end",
        "} function\tresult:{} {": "} function result: [result] {",
        "no mark {": "no mark {",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", X.filter_function_result("t").alias("x")).collect()
    assert {r.t: r.x for r in rows} == {**cases, None: None}


def test_natural_order_of_long_numbers(spark):
    keys = ["k9", "k10", "k123456789012345678901", "k123456789012345678902", "k0123456789012345678903", "k99999999999999999999999999", "a"]
    rows = spark.createDataFrame([(k,) for k in reversed(keys)], "k string").orderBy(FA.natural_key("k")).collect()
    assert [r.k for r in rows] == ["a", *keys[:-1]]


def test_rules_with_old_anchors(spark):
    since, utc = F.lit("2000-06-15").cast("timestamp"), F.lit("UTC")
    day = lambda rule, start, **kw: one(spark, F.date_format(CA.rrule_next(F.lit(rule), F.lit(start).cast("timestamp"), since, utc, **kw), "yyyy-MM-dd"))
    assert day("FREQ=DAILY", "1998-01-01") == "2000-06-15"
    assert day("FREQ=WEEKLY", "1900-01-01") == "2000-06-19"
    assert day("FREQ=MONTHLY", "1950-01-20") == "2000-06-20"
    assert day("FREQ=DAILY", "1998-01-01", max_steps=512) == "1999-05-28"


def test_alias_key_over_unicode(spark):
    same = [("Dvořák", "Dvorak"), ("Łódź", "Lodz"), ("Straße", "strasse"), ("Cafe\u0301", "café"), ("ØRSTED", "orsted"), ("Ångström  ", "angstrom"), ("Ирина", "ИРИНА")]
    rows = spark.createDataFrame(same, "a string, b string").select(X.alias_key("a").alias("a"), X.alias_key("b").alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert one(spark, X.alias_key(F.lit(" cafe"))) != one(spark, X.alias_key(F.lit("cafe")))
    assert one(spark, X.alias_key(F.lit(None).cast("string"))) is None


def test_upsert_reduces_its_batch(spark):
    old = spark.createDataFrame([("a", 1, "x")], "id string, n long, t string")
    batch = spark.createDataFrame([("a", 2, "y", 1), ("a", 3, "z", 2), ("b", 5, "p", 1), ("b", 5, "q", 1), ("b", 5, "q", 1)], "id string, n long, t string, o long")
    got = sorted((r.id, r.n, r.t, r.action) for r in upsert(old, batch, ["id"], ["o"]).collect())
    assert got == [("a", 3, "z", "updated"), ("b", 5, "q", "inserted")]


def test_imports_follow_the_order_of_lines(spark, tmp_path):
    path = tmp_path / "graph.ndjson"
    node = '{"nid":"n1","labels":["Product"],"title":"%s","props":{"aliases":["%s"]}}'
    path.write_text("\n".join([node % ("first", "Bob"), "", node % ("second", "BOB"), "{broken"] + [node % ("last", "bob")]))
    nodes = GL.import_nodes(D.read_graph_ndjson(spark, str(path), "nodes"))
    stored = spark.createDataFrame([], "id string, type string, title string, confidence double, status string")
    assert [r.title for r in GL.import_nodes_merge(stored, nodes).collect()] == ["last"]
    assert {r.alias for r in GL.import_aliases(nodes).collect()} == {"bob", "first", "second", "last"}
    edge = '{"rid":"r%d","type":"knows","src":"n1","dst":"n2","weight":%s}'
    path = tmp_path / "edges.ndjson"
    path.write_text("\n".join([edge % (1, "0.2"), edge % (2, "0.9"), edge % (3, "0.4")]))
    edges = GL.import_edges(D.read_graph_ndjson(spark, str(path), "relations"))
    none = spark.createDataFrame([], "id string, src_id string, dst_id string, type string, weight double, attrs_json string")
    once = GL.import_edges_merge(none, edges)
    assert [(r.weight, r.action) for r in once.collect()] == [(0.4, "inserted")]
    assert [(r.weight, r.action) for r in GL.import_edges_merge(once, edges).collect()] == [(0.4, "updated")]


def test_chunk_ids_of_sessions_that_start_together(spark):
    rows = [(i, s, "2024-01-01 00:00:00", "user", f"hello from {s}.") for i, s in enumerate(["a", "b"])]
    log = spark.createDataFrame(rows, "id long, session_id string, ts string, role string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = C.chunk_records(C.slide_chunks(C.timed_sentences(log))).collect()
    assert len({r.id for r in got}) == 2 and all(r.id.startswith("chat_20240101_000000_0000_") for r in got)


def test_a_lone_tag_is_a_list_of_one(spark):
    tasks = spark.createDataFrame([], AC.TASK_SCHEMA)
    acts = [(1, 1, '{"intent":"create_task","args":{"name":"a","tags":"home"}}'), (1, 2, '{"intent":"update_task","args":{"name":"a","tags":7}}'), (1, 3, '{"intent":"create_task","args":{"name":"b","tags":["x","y"]}}')]
    got = AC.actions_apply(tasks, spark.createDataFrame(acts, "owner long, at long, payload string")).collect()
    assert {(r.at, tuple(r.tags)) for r in got if r.kind == "result"} == {(1, ("home",)), (2, ("7",)), (3, ("x", "y"))}


def test_a_repeated_key_keeps_the_first_row(spark):
    from palimpsest.sources import sinks

    stored = spark.createDataFrame([("a", 1, "old")], "id string, n long, t string")
    batch = spark.createDataFrame([("a", 9, "x"), ("b", 2, "y"), ("b", 1, "z"), ("c", 5, None), ("c", 5, "w")], "id string, n long, t string").repartition(3)
    out = sorted((r.id, r.n, r.t) for r in sinks.append_rows(stored, batch).collect() if r.id != "c")
    assert out == [("a", 1, "old"), ("b", 1, "z")]
    assert [(r.id, r.t) for r in sinks.append_rows(stored, batch, order=["t"]).where("id = 'b'").collect()] == [("b", "y")]
    assert sinks.append_rows(stored, batch).count() == 3
