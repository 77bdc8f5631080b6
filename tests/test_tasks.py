"""Tasks, facts, action blocks."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import actions as AC
from palimpsest.operators import facts as FA
from palimpsest.operators import tasks as T

SCHEMA = AC.TASK_SCHEMA


def table(spark, *rows):
    """rows: (seq, name, date, start, updates)."""
    return spark.createDataFrame([(1, s, n, "low", None, d, st, None, list(u)) for s, n, d, st, u in rows], SCHEMA)


def test_upsert_merges_twice_in_a_batch(spark):
    old = table(spark, (1, "A", "2024-01-01", None, ["x"]), (2, "A", "2024-01-01", "", ["y"]), (3, "B", None, None, []))
    new = table(spark, (10, " a ", "2024-01-01", None, ["z", "x"]), (11, "A", "2024-01-01", None, ["w"]), (12, "C", None, "10:00", []))
    got = {r.seq: (r.name, r.updates, r.action) for r in T.task_upsert(old, new).collect()}
    assert got == {1: ("A", ["x", "z", "w"], "updated"), 2: ("A", ["y"], "kept"), 3: ("B", [], "kept"), 12: ("C", [], "inserted")}
    again = T.task_upsert(T.task_upsert(old, new).drop("action"), new)
    assert {r.seq: (r.name, r.updates) for r in again.collect()} == {k: v[:2] for k, v in got.items()}


def req(spark, *rows):
    return spark.createDataFrame([(i, 1, n, d, None, None) for i, (n, d) in enumerate(rows)], "req_id long, owner long, name string, date string, start string, end string")


def test_finish_first_delete_all(spark):
    t = table(spark, (1, "A", "2024-01-01", None, []), (2, "a", None, None, []), (3, "A", "2024-01-02", None, []))
    kept, done = T.task_finish(t, req(spark, ("a ", None), ("A", None)))
    assert [r.seq for r in kept.collect()] == [3] and sorted(r.seq for r in done.collect()) == [1, 2]
    assert T.task_delete(t, req(spark, ("a", None))).count() == 0
    assert sorted(r.seq for r in T.task_delete(t, req(spark, ("a", "2024-01-02"))).collect()) == [1, 2]


def test_loose_match_ignores_empty_fields(spark):
    t = table(spark, (1, "A", None, None, []), (2, "A", "2024-01-02", None, []))
    assert [r.seq for r in T.task_find(t, req(spark, ("A", "2024-01-02"))).collect()] == [2]
    assert [r.seq for r in T.task_find(t, req(spark, ("A", "2024-01-02")), loose=True).collect()] == [1]


def test_digest(spark):
    t = table(spark, (1, "old", "2024-01-01", None, []), (2, "now", "2024-02-01", "09:00", ["a", "b", "c"]), (3, "some day", None, None, []), (4, "later", "2024-05-01", None, []))
    want = (T.POLICY + "\n```Past:\n- old\n\nPresent (next 15 days):\n- [2024-02-01 09:00 (Thu)] (low) now Updates: b; c\n\nFuture:\n- later\n- some day```")
    assert T.task_digest(t, "2024-02-01").first().digest == want
    assert "- [low] now - 2024-02-01 09:00 Updates: b; c" in T.task_digest(t, "2024-02-01", "v1").first().digest


def run(spark, tasks, *actions):
    rows = [(1, i, json.dumps({"intent": k, "args": a})) for i, (k, a) in enumerate(actions, 100)]
    out = AC.actions_apply(tasks, spark.createDataFrame(rows, "owner long, at long, payload string"))
    return [(r.at, r.status) for r in out.where("kind = 'result'").orderBy("at").collect()], sorted((r.seq, r.name, r.date, r.updates) for r in out.where("kind = 'task'").collect())


def test_actions_in_order(spark):
    t = table(spark, (1, "A", "2024-01-01", None, ["x"]), (2, "A", None, None, []))
    results, left = run(
        spark, t, ("update_task", {"name": "a", "updates": "note"}), ("finish_task", {"name": "A"}), ("fetch_task", {"name": "A"}), ("create_task", {"name": "B", "date": "2024-02-02", "updates": ["u", "u", " "]}),
        ("create_task", {"name": "b", "date": "2024-02-02", "updates": ["v"]}), ("update_task", {"name": "B", "date": "2024-02-02", "time": {"start": "10:00"}}), ("delete_task", {"name": "zzz"}),
        ("create_task", {}), ("dance", {"name": "A"}),
    )
    assert [s for _, s in results] == ["updated", "finished", "found", "inserted", "updated", "updated", "not_found", "missing_name", "not_implemented"]
    # the update moved B to a new start: the old row stays beside the new one
    assert left == [(2, "A", None, []), (103, "b", "2024-02-02", ["u", "v"]), (105, "b", "2024-02-02", ["u", "v"])]


def test_delete_takes_every_match(spark):
    t = table(spark, (1, "A", "2024-01-01", None, []), (2, "A", "2024-01-02", None, []))
    assert run(spark, t, ("delete_task", {"name": "A"})) == ([(100, "deleted")], [])


def test_fences(spark):
    text = '~~~Action {“intent”: "x",} ~~~ t ~~~memory\n{"op":"upsert"}\n~~~ ~~~x {bad} ~~~ ~~~y no json ~~~'
    rows = AC.fence_extract(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("pos").collect()
    assert [(r.tag, r.ok) for r in rows] == [("action", True), ("memory", True), ("x", False)]
    assert json.loads(rows[0].payload) == {"intent": "x"}


def test_tool_calls(spark):
    calls = json.dumps([{"id": "1", "type": "function", "function": {"name": "action", "arguments": "{}"}}, {"id": "2", "type": "x", "function": {"name": "a"}}, {"id": "3", "type": "function", "function": {"name": "m", "arguments": "{"}}])
    rows = AC.tool_calls_extract(spark.createDataFrame([(1, calls)], "id long, tool_calls_json string")).orderBy("pos").collect()
    assert [(r.call_id, r.error) for r in rows] == [("1", None), ("2", "bad_tool_call"), ("3", "invalid_json")]


def test_interest_priority(spark):
    call = lambda a: json.dumps([{"type": "function", "function": {"name": "interest", "arguments": json.dumps(a)}}])
    block = lambda a, tag="interest": f"~~~{tag} {json.dumps(a)} ~~~"
    rows = [
        (1, block({"topics": ["t"], "confidence": 0.1}), call({"topics": ["c"], "confidence": 2}), None),
        (2, block({"topics": ["t"], "confidence": 0.1}), call({"topics": [], "confidence": 2}), None),  # says nothing: the text decides
        (3, block({"topics": ["t"], "confidence": "no"}), None, None),
        (4, block({"topics": list("abcdef"), "confidence": -1}, "other"), None, None),
        (5, "x", None, json.dumps({"handled": [{"tag": "interest", "payload": {"reason": "r", "confidence": 0.3}}]})),
    ]
    df = spark.createDataFrame(rows, "id long, text string, tool_calls_json string, router_json string")
    got = {r.id: (r.topics, r.reason, r.confidence) for r in AC.interest_extract(df).collect()}
    assert got == {1: (["c"], "", 1.0), 2: (["t"], "", 0.1), 4: (["a", "b", "c", "d"], "", 0.0), 5: ([], "r", 0.3)}


def facts(spark, *rows):
    return spark.createDataFrame([(1, k, f, i) for i, (k, f) in enumerate(rows)], "owner long, key string, fact string, pos long")


def test_facts(spark):
    f = facts(spark, ("k10", "a"), ("K2", "b"), ("k10", "a"), ("k10", " "), ("k10", "c"))
    assert FA.facts_render(f).first().line == "memories: keys=K2,k10 | K2[b] | k10[a; c]"
    none = spark.createDataFrame([(1,), (2,)], "owner long")
    assert {r.owner: r.line for r in FA.facts_render(f, none).collect()}[2] == FA.NO_FACTS
    gone = spark.createDataFrame([(1, "*", "a"), (1, "k10", "b")], "owner long, key string, fact string")
    assert [r.fact for r in FA.facts_forget(f, gone).where("fact <> ' '").orderBy("pos").collect()] == ["b", "c"]


def test_facts_apply_replays_in_order(spark):
    store = facts(spark, ("A", "x"), ("B", "x"), ("A", "y"))
    ops = [("delete", "A", "x"), ("upsert", "A", "x"), ("delete", "*", "y"), ("upsert", "", "z"), ("upsert", None, "z"), ("nope", "A", "q"), ("upsert", "A", " "), ("upsert", "C", "y")]
    df = spark.createDataFrame([(1, i, *o) for i, o in enumerate(ops)], "owner long, at long, op string, key string, fact string")
    left, results = FA.facts_apply(store, df)
    assert [(r.key, r.fact) for r in left.orderBy("gen", "pos").collect()] == [("B", "x"), ("A", "x"), ("General", "z"), ("C", "y")]
    assert [r.status for r in results.orderBy("at").collect()] == ["forgot", "remembered", "forgot", "remembered", "remembered", "bad_request", "bad_request", "remembered"]


def test_extract_tid(spark):
    df = spark.createDataFrame([(["a", " TID=AF01 ", "TID=2"],), (["TID=xyz"],), ([],)], "u array<string>")
    assert [r[0] for r in df.select(T.extract_tid(F.col("u"))).collect()] == ["af01", None, None]


def test_one_name_with_most_requests(spark):
    t = spark.range(3000).selectExpr("1L AS owner", "id * 1000000 AS seq", "'A' AS name", "CAST(NULL AS STRING) AS importance", "CAST(NULL AS ARRAY<STRING>) AS tags", "CASE WHEN id % 2 = 0 THEN '2024-01-01' END AS date", "CAST(NULL AS STRING) AS start", "CAST(NULL AS STRING) AS `end`", "ARRAY('x') AS updates")
    r = spark.range(1000).selectExpr("id AS req_id", "1L AS owner", "' a ' AS name", "CAST(NULL AS STRING) AS date", "CAST(NULL AS STRING) AS start", "CAST(NULL AS STRING) AS `end`")
    r = r.unionByName(spark.createDataFrame([(5000, 1, "A", "2024-01-01"), (5001, 2, "A", None)], "req_id long, owner long, name string, date string").selectExpr("*", "CAST(NULL AS STRING) AS start", "CAST(NULL AS STRING) AS `end`"))
    kept, archived = T.task_finish(t, r)
    done = sorted((x.seq // 1000000, x.req_id) for x in archived.collect())
    assert done == [(i, i) for i in range(1000)] and kept.count() == 2000  # the dated request takes the first match, which is taken anyway
