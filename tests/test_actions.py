"""The fold of actions over a name's tasks against a plain replay."""

import json
import random

import pytest

from palimpsest.operators import actions as AC

TIMES = ("date", "start", "end")


def replay(stored, actions):
    """(results, tasks) of one owner: one action after the other over the list of all tasks."""
    tasks = [dict(t) for t in stored]
    results = []
    text = lambda v: None if v is None else str(v)
    blank = lambda v: v or ""
    times = lambda t: tuple(blank(t[k]) for k in TIMES)
    lines = lambda v: list(dict.fromkeys(s for s in (x.strip() for x in ([v] if isinstance(v, str) else v or [])) if s))

    def put(new):
        for t in tasks:
            if t["name"].lower() == new["name"].lower() and times(t) == times(new):
                t.update({**new, "seq": t["seq"], "updates": list(dict.fromkeys(t["updates"] + new["updates"]))})
                return "updated"
        tasks.append(dict(new))
        return "inserted"

    for at, intent, args in actions:
        name = (args.get("name") or "").strip()
        mine = [t for t in tasks if t["name"].strip().lower() == name.lower()]
        same = lambda t, ks: all(args.get(k) is None or blank(t[k]) == args[k] for k in ks)
        status, hit = "not_found", None
        if intent == "fetch_task":
            hit = next((t for t in mine if not isinstance(args.get("date"), str) or blank(t["date"]) == args["date"]), None)
            status = "found" if hit else status
        elif intent not in AC.TASK_INTENTS:
            status = "not_implemented"
        elif not name:
            status = "missing_name"
        elif intent == "create_task":
            time = args["time"] if isinstance(args.get("time"), dict) else args
            hit = {"seq": at, "name": name, "importance": text(args.get("importance")), "tags": args.get("tags"), "date": blank(time.get("date")), "start": time.get("start") or None, "end": time.get("end") or None, "updates": lines(args.get("updates"))}
            status = put(hit)
        elif intent == "update_task":
            old = next((t for t in mine if args.get("date") is None or not t["date"] or t["date"] == args["date"]), None)
            if old:
                hit = dict(old)
                for k in ("importance",):
                    if k in args:
                        hit[k] = blank(args[k])
                if "tags" in args:
                    hit["tags"] = args["tags"] or []
                for source in ([args["time"]] if isinstance(args.get("time"), dict) else []) + [args]:
                    hit.update({k: blank(source[k]) or (None if k != "date" else "") for k in TIMES if k in source})
                hit["updates"] = list(dict.fromkeys(old["updates"] + lines(args.get("updates"))))
                if times(hit) != times(old):
                    hit["seq"] = at
                status = "updated"
                put(hit)
        else:
            gone = [t for t in mine if same(t, TIMES)]
            gone = gone[:1] if intent == "finish_task" else gone
            if gone:
                status, hit = {"finish_task": "finished"}.get(intent, "deleted"), gone[0]
                tasks = [t for t in tasks if all(t is not g for g in gone)]
        results.append((at, intent, status, None if status == "not_found" or hit is None else tuple(map(str, hit.values()))))
        results += [(at, "archived", status, tuple(map(str, hit.values())))] if status == "finished" else []
    return results, [tuple(map(str, t.values())) for t in tasks]


def random_actions(rnd, n):
    out = []
    for at in range(100, 100 + n):
        args = {"name": rnd.choice(["a", " A ", "A", "b", "B", "", "c"])}
        for k, values in (("date", ["2024-01-01", "2024-01-02", "", None]), ("start", ["09:00", None]), ("importance", ["high", None]), ("tags", [["x"], ["y", "z"], None]), ("updates", ["n1", ["n1", " n2 ", ""], None])):
            if rnd.random() < 0.35:
                args[k] = rnd.choice(values)
        if rnd.random() < 0.2:
            args["time"] = rnd.choice([{"date": "2024-01-02", "end": "12:00"}, {"start": None}, "x"])
        out.append((at, rnd.choice([*AC.TASK_INTENTS, "create_task", "create_task", "update_task", "dance"]), args))
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_against_a_replay(spark, block):
    rnd = random.Random(block)
    columns = ("seq", "name", "importance", "tags", "date", "start", "end", "updates")
    rows, acts, want, left = [], [], [], []
    for owner in range(12):
        stored = [dict(zip(columns, (i, rnd.choice(["a", "A", "b", "d"]), None, None, rnd.choice(["2024-01-01", None, ""]), rnd.choice([None, "09:00"]), None, rnd.choice([[], ["s"]])))) for i in range(rnd.randint(0, 5))]
        mine = random_actions(rnd, 40)
        results, tasks = replay(stored, mine)
        rows += [(owner, *t.values()) for t in stored]
        acts += [(owner, at, json.dumps({"intent": intent.upper(), "args": args})) for at, intent, args in mine]
        want += [(owner, *r) for r in results]
        left += [(owner, t) for t in tasks]
    out = AC.actions_apply(spark.createDataFrame(rows, AC.TASK_SCHEMA), spark.createDataFrame(acts, "owner long, at long, payload string"), block).collect()
    task = lambda r: None if r.seq is None else tuple(str(r[c]) for c in columns)
    got = [(r.owner, r.at, "archived" if r.kind == "archived" else r.intent, r.status, task(r)) for r in out if r.kind != "task"]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((r.owner, task(r)) for r in out if r.kind == "task") == sorted(left)


def test_a_deletion_by_name_ends_a_part(spark):
    acts = [(1, i, json.dumps({"intent": "delete_task" if i % 50 == 0 else "create_task", "args": {"name": "a"} if i % 50 == 0 else {"name": "a", "date": f"d{i % 3}", "updates": f"u{i}"}})) for i in range(1, 2001)]
    df = spark.createDataFrame(acts, "owner long, at long, payload string")
    blocks = AC._blocks(AC.parsed_actions(df), 64).collect()
    assert {r.turn for r in blocks} == {0, 1} and sum(len(r.acts) for r in blocks) == 2000 and max(len(r.acts) for r in blocks) <= 64  # blocks are of the whole name: a part may lie in two
    out = AC.actions_apply(spark.createDataFrame([], AC.TASK_SCHEMA), df, 64)
    assert out.where("kind = 'task'").count() == 0
    assert {r.status: r["count"] for r in out.where("kind = 'result'").groupBy("status").count().collect()} == {"deleted": 40, "inserted": 120, "updated": 1840}


def test_payloads_that_say_little(spark):
    acts = [(1, 1, "{}"), (1, 2, "[]"), (1, 3, "{bad"), (1, 4, None), (1, 5, json.dumps({"intent": "create_task", "args": [1]})), (1, 6, json.dumps({"intent": "fetch_task", "args": {"name": None, "date": 5}})),
            (1, 7, json.dumps({"intent": "create_task", "args": {"name": 7, "date": 20240101, "tags": "one", "updates": {"a": "x", "b": " x "}}}))]
    out = AC.actions_apply(spark.createDataFrame([(1, 9, None, None, None, None, None, None, None)], AC.TASK_SCHEMA), spark.createDataFrame(acts, "owner long, at long, payload string")).collect()
    assert {r.at: r.status for r in out if r.kind == "result"} == {1: "not_implemented", 2: "not_implemented", 3: "not_implemented", 4: "not_implemented", 5: "missing_name", 6: "found", 7: "inserted"}
    made = next(r for r in out if r.kind == "task" and r.seq == 7)
    assert (made.name, made.date, made.tags, made.updates) == ("7", "20240101", ["one"], ["x"])
