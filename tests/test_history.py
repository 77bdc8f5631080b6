"""Message log: stamps, tool repair, budgets, row plans."""

import json
import random

from pyspark.sql import functions as F

from palimpsest.operators import history as H
from palimpsest.operators import messages as M
from palimpsest.sources import messages as S

MSG = "id long, session_id string, ts timestamp, role string, content string, is_summary boolean, tool_call_id string, tool_calls_json string"


def log(spark, rows):
    """rows: (id, minute, role, content[, call id, calls])."""
    full = []
    for r in rows:
        i, minute, role, content, *rest = r
        cid, calls = (rest + [None, None])[:2]
        full.append((i, "s", minute, role, content, False, cid, json.dumps([{"id": c, "type": "function"} for c in calls]) if calls is not None else None))
    df = spark.createDataFrame(full, MSG.replace("ts timestamp", "m long"))
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60)).drop("m")


def test_stamp_counts_from_last_stamped(spark):
    rows = [(i, m, "user", "x") for i, m in enumerate([0, 1, 3, 6, 10, 15])]
    got = H.group_stamps(log(spark, rows)).orderBy("id").collect()
    assert [r.stamped for r in got] == [True, False, False, True, False, True]
    assert got[0].content == "[01.01Mon 00:00] x"


def test_stamp_at_midnight(spark):
    rows = [(1, 1439, "user", "x"), (2, 1440, "user", "y")]
    assert [r.stamped for r in H.group_stamps(log(spark, rows)).orderBy("id").collect()] == [True, True]
    local = H.group_stamps(log(spark, rows), tz="America/New_York").orderBy("id").collect()
    assert [r.stamped for r in local] == [True, False]


def repaired(spark, rows):
    out = H.reconcile_tools(log(spark, rows)).orderBy("ord").collect()
    return [(r.role, r.content, r.tool_call_id) for r in out]


def test_tool_repair(spark):
    rows = [
        (1, 0, "tool", "stray", "z"), (2, 0, "user", "q"), (3, 0, "assistant", "a", None, ["c1", "c2", "c3"]), (4, 0, "tool", "second first", "c2"),
        (5, 0, "tool", "r1", None), (6, 0, "tool", "r2", "c2"), (7, 0, "user", "next"), (8, 0, "assistant", "b", None, ["d1"]),
    ]
    assert repaired(spark, rows) == [
        ("user", "q", None), ("assistant", "a", None), ("tool", "r1", "c1"), ("tool", "r2", "c2"), ("tool", H.PLACEHOLDER, "c3"), ("user", "next", None),
        ("assistant", "b", None), ("tool", H.PLACEHOLDER, "d1"),
    ]


def plain_repair(rows):
    out, todo = [], []
    for _, _, role, content, *rest in rows:
        cid, calls = (rest + [None, None])[:2]
        if role == "tool":
            if todo and cid in (None, "", todo[0]):
                out.append((role, content, todo.pop(0)))
            continue
        out += [("tool", H.PLACEHOLDER, c) for c in todo]
        todo = list(calls or []) if role == "assistant" else []
        out.append((role, content, None))
    return out + [("tool", H.PLACEHOLDER, c) for c in todo]


def test_tool_repair_random(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        role = rng.choice(["assistant", "tool", "tool", "tool", "user"])
        calls = rng.sample("abcd", rng.randint(0, 4)) if role == "assistant" else None
        rows.append((i, 0, role, f"m{i}", rng.choice([None, "", *"abcde"]) if role == "tool" else None, calls))
    assert repaired(spark, rows) == plain_repair(rows)


def test_unique_tool_rows(spark):
    rows = [(1, 0, "tool", H.PLACEHOLDER, "c"), (2, 0, "tool", "real", "c"), (3, 0, "tool", H.PLACEHOLDER, "d"), (4, 0, "user", "hi"), (5, 0, "tool", H.PLACEHOLDER)]
    assert sorted(r.id for r in H.unique_tool_rows(log(spark, rows)).collect()) == [2, 3, 4]


def test_persist_plan_scenario(spark):
    rows = [
        (1, 0, "system", "Memories: x"), (2, 0, "system", "[Memory v2] y"), (3, 0, "system", "12/24/2025 list"), (4, 0, "user", ""), (5, 0, "user", "hello"),
        (6, 0, "system", "function result: {}"), (7, 0, "tool", "no id"), (8, 0, "user", "Continue please"), (9, 0, "user", "continue again"),
        (10, 0, "tool", "ok", "c1"), (11, 0, "assistant", "fine"), (12, 0, "system", "Rules"), (13, 0, "system", "function result: {}"), (14, 0, "user", "stop"),
    ]
    got = {r.id: r.op for r in M.persist_plan(log(spark, rows)).collect()}
    assert got == {
        1: "skip_ephemeral", 2: "skip_ephemeral", 3: "skip_ephemeral", 4: "skip_empty", 5: "insert", 6: "router_trace", 7: "skip_tool_without_id", 8: "skip_nudge",
        9: "insert", 10: "insert", 11: "skip_assistant", 12: "insert", 13: "router_trace", 14: "insert",
    }


def test_first_ephemeral_only(spark):
    rows = [(1, 0, "system", "Memories: a"), (2, 0, "system", "memories: b"), (3, 0, "system", "on 2024-01-01"), (4, 0, "system", "Current time is: x"), (5, 0, "system", "[Memory v1]")]
    assert sorted(r.id for r in M.filter_first_ephemeral(log(spark, rows)).collect()) == [2, 4]


def test_budget_is_kept(spark):
    rng = random.Random(8)
    rows = [(i, i, rng.choice(["user", "assistant"]), "w" * rng.randint(1, 400)) for i in range(1, 140)]
    msgs = log(spark, rows)
    system = spark.createDataFrame([("s", 1, "system", "p" * 800), ("s", 2, "system", "q" * 9000), ("s", 3, "system", "r")], "session_id string, ord long, role string, content string")
    out = H.budget_pack(msgs, system, max_ctx=2000, reserve=500)
    assert out.agg(F.sum("tokens")).first()[0] <= 1500
    assert [r.ord for r in out.where("section = 0").collect()] == [1]  # the first overflow ends the system rows
    hist = sorted(r.ord for r in out.where("section = 2").collect())
    assert hist == list(range(hist[0], 140))
    ref = H.budget_pack(msgs, system, max_ctx=2000, reserve=500, mode="reference")
    assert ref.where("section = 2").count() == 100


def test_sink_dedupes_exact_or_by_content(spark):
    m = log(spark, [(1, 0, "user", "x"), (2, 1, "user", "x"), (3, 1, "user", "x")])
    empty = m.where("false")
    assert S.new_messages(m, empty).count() == 2
    assert [r.id for r in S.new_messages(m, empty, "content").collect()] == [1]
    assert S.new_messages(m, m).count() == 0


def test_inclusive_mark(spark):
    m = log(spark, [(1, 0, "user", "x"), (2, 1, "user", "y"), (3, 1, "user", "z")])
    since = "2024-01-01 00:01:00"
    assert S.scan_messages_since(m, since, inclusive=True).count() == 2
    assert [r.id for r in S.scan_messages_since(m, since, after_id=2).collect()] == [3]


def test_response_shapes(spark):
    rows = [
        ('{"content":[{"type":"tool"},{"type":"text","text":"A"}]}', "blocks"), ('{"output_text":"B"}', "output"),
        ('{"output":[{"content":[{"text":"C"}]},{"text":"D"}]}', "output"), ('{"odd":1}', "output"), ('{"choices":[{"message":{"content":"","reasoning_content":"E"}}]}', "choices"), ("{}", "none"),
    ]
    df = spark.createDataFrame(rows, "r string, s string").select(M.response_text(F.col("r"), F.col("s")))
    assert [r[0] for r in df.collect()] == ["A", "B", "C\n\nD", '{"odd":1}', "E", ""]
