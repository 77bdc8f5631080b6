"""Action blocks in texts, tool calls, and their effects on tasks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.messages import CALLS
from palimpsest.operators.ordered import cell_scan, id_cell
from palimpsest.session import checkpointed

# --- fixed values -----------------------------------------------------------------------------------------
FENCE = r"~~~(\w+)\s*(\{[\s\S]*?\})\s*~~~"
MAX_TOPICS = 4
TASK_INTENTS = ["fetch_task", "create_task", "update_task", "delete_task", "finish_task"]
# -----------------------------------------------------------------------------------------------------------


def fence_extract(texts: DataFrame, key: str = "id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per ``~~~tag {json}~~~`` block: (key, pos, tag, payload, ok)."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)).alias("p"))
    rows = texts.where(F.col(text).contains("~~~")).select(key, *(keep or []), F.posexplode(pairs).alias("pos", "b"))
    rows = rows.select(key, *(keep or []), "pos", F.lower("b.t").alias("tag"), X.json_lenient(F.col("b.p")).alias("payload"))
    return rows.withColumn("ok", F.col("payload").isNotNull())


def tool_calls_extract(rows: DataFrame, key: str = "id", calls: str = "tool_calls_json") -> DataFrame:
    """One row per tool call: (key, pos, call_id, fn, args, error)."""
    parsed = F.from_json(calls, CALLS)
    out = rows.select(key, F.posexplode(parsed).alias("pos", "c"))
    fn = F.coalesce("c.function.name", F.lit(""))
    args = X.json_lenient(F.coalesce("c.function.arguments", F.lit("{}")))
    bad = (F.lower(F.coalesce("c.type", F.lit(""))) != "function") | (fn == "")
    error = F.when(bad, "bad_tool_call").when(args.isNull(), "invalid_json")
    return out.select(key, "pos", F.coalesce("c.id", F.lit("")).alias("call_id"), fn.alias("fn"), F.when(~bad, args).alias("args"), error.alias("error"))


def action_classify(tag: Column, error: Column, is_tool: Column) -> Column:
    """struct<handled, status> of a block or call."""
    low = F.lower(tag)
    status = (
        F.when(error.isNotNull(), error)
        .when(low.isin("action", "memory"), "executed")
        .when(low.isin("interest", "debug"), "for_server_execute")
        .otherwise("reserved")
    )
    handled = error.isNull() & (low.isin("action", "memory", "interest", "debug") | is_tool)
    return F.struct(handled.alias("handled"), status.alias("status"))


def route_counts(classified: DataFrame, key: str = "id") -> DataFrame:
    """Handled and unhandled blocks per response."""
    return classified.groupBy(key).agg(F.count_if("handled").alias("handled"), F.count_if(~F.col("handled")).alias("unhandled"))


def _interest(payload: Column) -> Column:
    topics = F.from_json(F.get_json_object(payload, "$.topics"), "array<string>")
    conf = F.get_json_object(payload, "$.confidence").try_cast("double")
    good = conf.isNotNull() & ~F.isnan(conf) & (F.abs(conf) != float("inf"))
    fields = F.struct(
        F.slice(F.coalesce(topics, F.array().cast("array<string>")), 1, MAX_TOPICS).alias("topics"),
        F.coalesce(F.get_json_object(payload, "$.reason"), F.lit("")).alias("reason"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
    )
    return F.when(good, fields)


def _useful(i: Column) -> Column:
    return i.isNotNull() & ((F.size(i["topics"]) > 0) | (i["reason"] != ""))


def interest_extract(rows: DataFrame, key: str = "id", text: str = "text", calls: str = "tool_calls_json", router: str = "router_json") -> DataFrame:
    """Interest of a response: from its tool calls, else the router's payload; if that says nothing, from the text.

    All candidates sit in one row, so nothing is shuffled.
    """
    named = F.filter(F.from_json(calls, CALLS), lambda c: (c["type"] == "function") & (F.lower(c["function"]["name"]) == "interest"))
    from_call = X.json_lenient(F.get(named, 0)["function"]["arguments"])
    handled = F.filter(F.from_json(F.get_json_object(router, "$.handled"), "array<struct<tag:string,payload:string>>"), lambda h: F.lower(h["tag"]) == "interest")
    first = _interest(F.coalesce(from_call, F.get(handled, 0)["payload"]))
    tags, pays = F.regexp_extract_all(text, F.lit("(?i)" + FENCE), F.lit(1)), F.regexp_extract_all(text, F.lit("(?i)" + FENCE), F.lit(2))
    blocks = F.filter(F.arrays_zip(tags.alias("t"), pays.alias("p")), lambda b: F.json_array_length(F.concat(F.lit("["), b["p"], F.lit("]"))) == 1)
    tagged = F.get(F.filter(blocks, lambda b: F.lower(b["t"]) == "interest"), 0)["p"]
    shaped = F.get(F.filter(blocks, lambda b: F.get_json_object(b["p"], "$.topics").startswith("[") & F.get_json_object(b["p"], "$.confidence").try_cast("double").isNotNull()), 0)["p"]
    second = _interest(F.coalesce(tagged, shaped))
    best = F.when(_useful(first), first).when(_useful(second), second)
    return rows.select(key, best.alias("i")).where("i IS NOT NULL").select(key, "i.*")


# --- effects on tasks --------------------------------------------------------------------------------------
TASK_SCHEMA = "owner bigint, seq bigint, name string, importance string, tags array<string>, date string, start string, end string, updates array<string>"
TASK = "struct<seq:bigint,name:string,importance:string,tags:array<string>,date:string,start:string,end:string,updates:array<string>>"
RESULT = f"struct<at:bigint,intent:string,status:string,task:{TASK}>"
STATE = f"struct<tasks:array<{TASK}>,out:array<{RESULT}>>"
ROW = f"struct<kind:string,at:bigint,intent:string,status:string,task:{TASK}>"
TIMES = ("date", "start", "end")
FIELDS = ("seq", "name", "importance", "tags", *TIMES, "updates")
BLOCK_ACTIONS = 256


def _kind(v: Column, path: str) -> Column:
    """Type of a value; null if the key is missing, VOID if its value is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _strings(v: Column, path: str) -> Column:
    """A value as strings: the items of a list, the values of an object, else itself; none if it is null."""
    kind, blank = _kind(v, path), F.array().cast("array<string>")
    items = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(v, path, "array<string>"))
        .when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v, path, "map<string,string>")))
        .when(kind == "VOID", blank)
        .otherwise(F.array(F.try_variant_get(v, path, "string")))
    )
    return F.transform(F.when(kind.isNotNull(), F.coalesce(items, blank)), lambda s: F.coalesce(s, F.lit("")))


def _lines(v: Column, path: str) -> Column:
    """Distinct trimmed lines that are not empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(_strings(v, path), F.array().cast("array<string>")), X.trim_ws), lambda s: s != ""))


def parsed_actions(actions: DataFrame) -> DataFrame:
    """Payloads (owner, at, payload JSON) as columns, each argument read once.

    ``find`` has the times asked for (null: any); ``made`` the task that a creation stores; ``change`` the fields that an
    update sets, each beside whether it is given: flat times go before those of a nested ``time``.
    """
    intent = F.lower(F.coalesce(F.get_json_object("payload", "$.intent"), F.lit("")))
    args = F.coalesce(F.try_parse_json(F.coalesce(F.get_json_object("payload", "$.args"), F.lit("{}"))), F.parse_json(F.lit("{}")))
    a = actions.select("owner", F.col("at").cast("long").alias("seq"), "payload", intent.alias("intent"), args.alias("v"))
    v = F.col("v")
    get = lambda path: F.try_variant_get(v, path, "string")
    nested = F.coalesce(_kind(v, "$.time").startswith("OBJECT"), F.lit(False))
    flat = {k: get(f"$.{k}") for k in TIMES}
    deep = {k: get(f"$.time.{k}") for k in TIMES}
    has = lambda path: _kind(v, path).isNotNull()
    name = X.trim_ws(F.coalesce(get("$.name"), F.lit("")))
    new = {k: F.when(nested, deep[k]).otherwise(flat[k]) for k in TIMES}
    blank_to_null = lambda c: F.when(c != "", c)
    made = F.struct(
        F.col("seq"), name.alias("name"), get("$.importance").alias("importance"), F.when(get("$.tags").isNotNull() | (_kind(v, "$.tags") != "VOID"), _strings(v, "$.tags")).alias("tags"),
        F.coalesce(new["date"], F.lit("")).alias("date"), blank_to_null(new["start"]).alias("start"), blank_to_null(new["end"]).alias("end"), _lines(v, "$.updates").alias("updates"),
    )
    given = {k: has(f"$.{k}") | (nested & has(f"$.time.{k}")) for k in TIMES}
    value = {k: F.coalesce(F.when(has(f"$.{k}"), flat[k]).otherwise(deep[k]), F.lit("")) for k in TIMES}
    change = F.struct(
        has("$.importance").alias("has_importance"), F.coalesce(get("$.importance"), F.lit("")).alias("importance"), has("$.tags").alias("has_tags"), _strings(v, "$.tags").alias("tags"),
        *[given[k].alias(f"has_{k}") for k in TIMES], *[(value[k] if k == "date" else blank_to_null(value[k])).alias(k) for k in TIMES], _lines(v, "$.updates").alias("updates"),
    )
    only_text = F.when(_kind(v, "$.date") == "STRING", flat["date"])
    find = F.struct(F.when(intent_is("fetch_task"), only_text).otherwise(flat["date"]).alias("date"), flat["start"].alias("start"), flat["end"].alias("end"))
    return a.select("owner", F.lower(name).alias("lname"), "seq", "payload", "intent", name.alias("name"), find.alias("find"), made.cast(TASK).alias("made"), change.alias("change"))


def intent_is(*names: str) -> Column:
    return F.col("intent").isin(*names)


def _same(want: Column, have: Column) -> Column:
    return want.isNull() | (F.coalesce(have, F.lit("")) == want)


def _strict(x: Column, t: Column) -> Column:
    return _same(x["find"]["date"], t["date"]) & _same(x["find"]["start"], t["start"]) & _same(x["find"]["end"], t["end"])


def _put(tasks: Column, new: Column) -> Column:
    """The first task of the same times takes the new one's fields, its own place and all notes; else the new one comes last."""
    key = lambda t: F.concat_ws("\x1f", *[F.coalesce(t[k], F.lit("")) for k in TIMES])
    notes = lambda t: F.array_distinct(F.concat(t["updates"], new["updates"]))
    merged = lambda t: F.struct(t["seq"].alias("seq"), *[new[k].alias(k) for k in FIELDS[1:-1]], notes(t).alias("updates")).cast(TASK)
    return X.bound(
        F.array_position(F.transform(tasks, key), key(new)),
        lambda at: F.when(at > 0, F.transform(tasks, lambda t, i: F.when(i == at - 1, merged(t)).otherwise(t))).otherwise(F.concat(tasks, F.array(new))),
    )


def _step(state: Column, x: Column) -> Column:
    """The tasks of one name after an action, and its result added to ``out``."""
    tasks = state["tasks"]

    def done(status, task, left) -> Column:
        result = F.struct(x["seq"].alias("at"), x["intent"].alias("intent"), status.alias("status"), task.alias("task")).cast(RESULT)
        return F.struct(left.alias("tasks"), F.concat(state["out"], F.array(result)).alias("out")).cast(STATE)

    none = F.lit(None).cast(TASK)
    no = lambda word: done(F.lit(word), none, tasks)

    def changed(hit: Column) -> Column:
        c = x["change"]
        set_ = lambda k: F.when(c[f"has_{k}"], c[k]).otherwise(hit[k])
        moved = ~_same_times({k: set_(k) for k in TIMES}, hit)
        seq = F.when(moved, x["seq"]).otherwise(hit["seq"])  # with other times the old row stays and the new one is stored beside it
        notes = F.when(F.size(c["updates"]) > 0, F.array_distinct(F.concat(hit["updates"], c["updates"]))).otherwise(hit["updates"])
        return F.struct(seq.alias("seq"), hit["name"].alias("name"), *[set_(k).alias(k) for k in FIELDS[2:-1]], notes.alias("updates")).cast(TASK)

    fetch = X.bound(F.get(F.filter(tasks, lambda t: _same(x["find"]["date"], t["date"])), 0), lambda hit: done(F.when(hit.isNull(), "not_found").otherwise("found"), hit, tasks))
    made = x["made"]
    is_there = F.exists(tasks, lambda t: _same_times(t, made))
    create = done(F.when(is_there, "updated").otherwise("inserted"), made, _put(tasks, made))
    loose = lambda t: _same(x["find"]["date"], t["date"]) | (F.coalesce(t["date"], F.lit("")) == "")
    update = X.bound(F.get(F.filter(tasks, loose), 0), lambda hit: F.when(hit.isNull(), no("not_found")).otherwise(X.bound(changed(hit), lambda new: done(F.lit("updated"), new, _put(tasks, new)))))
    gone = F.filter(tasks, lambda t: _strict(x, t))
    delete = X.bound(gone, lambda g: done(F.when(F.size(g) > 0, "deleted").otherwise("not_found"), F.get(g, 0), F.filter(tasks, lambda t: ~_strict(x, t))))
    finish = X.bound(
        F.array_position(F.transform(tasks, lambda t: _strict(x, t)), True),
        lambda at: F.when(at == 0, no("not_found")).otherwise(done(F.lit("finished"), F.get(tasks, (at - 1).cast("int")), F.filter(tasks, lambda t, i: i != at - 1))),
    )
    of = x["intent"]
    return (
        F.when(of == "fetch_task", fetch).when(~of.isin(*TASK_INTENTS), no("not_implemented")).when(x["name"] == "", no("missing_name"))
        .when(of == "create_task", create).when(of == "update_task", update).when(of == "delete_task", delete).otherwise(finish)
    )


def _same_times(a: Column, b: Column) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.coalesce(a[k], F.lit("")) == F.coalesce(b[k], F.lit("")) for k in TIMES])


def _blocks(a: DataFrame, size: int) -> DataFrame:
    """(owner, lname, part, turn, turns, first, acts): up to ``size`` actions of a name each, in order.

    A deletion by name alone leaves nothing behind, so it ends a part, and parts are independent. The blocks of a part take
    turns. Actions without a name change nothing: each of their blocks is a first one.
    """
    clears = (intent_is("delete_task") & (F.col("lname") != "") & F.col("find.date").isNull() & F.col("find.start").isNull() & F.col("find.end").isNull()).cast("long")
    keys, order = ["owner", "lname"], ["seq", "payload"]
    a = cell_scan(a.withColumn("clears", clears), keys, order, id_cell("seq"), rank="rn", sums={"cleared": F.col("clears")})
    part = F.col("cleared") - F.col("clears")
    packed = F.struct(*order, "intent", "name", "find", "made", "change")
    b = a.groupBy(*keys, part.alias("part"), F.floor((F.col("rn") - 1) / size).alias("b")).agg(F.array_sort(F.collect_list(packed)).alias("acts"))
    of = Window.partitionBy(*keys, "part")
    turn = F.row_number().over(of.orderBy("b")) - 1
    named = F.col("lname") != ""
    b = b.withColumn("t", turn).withColumn("turns", F.when(named, F.count("*").over(of)).otherwise(1))
    return b.select(*keys, "part", F.when(named, F.col("t")).otherwise(0).alias("turn"), "turns", (F.col("t") == 0).alias("first"), "acts")


def actions_apply(tasks: DataFrame, actions: DataFrame, block: int = BLOCK_ACTIONS) -> DataFrame:
    """Apply action payloads (owner, at, payload JSON) in order of ``at``: rows of kind task, result or archived.

    Every intent looks tasks up by name, so the state is the tasks of one name of one owner. Their actions are folded over
    that state a block at a time, in column expressions; the blocks of one name take turns, a round for each. Names with at most
    ``block`` actions between two deletions by name alone, as nearly all are, need one round. Rows of one ``at`` are
    ordered by payload.
    """
    keys = ["owner", "lname"]
    stored = tasks.withColumn("lname", F.lower(X.trim_ws(F.coalesce("name", F.lit("")))))
    one = F.struct(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "updates" else F.col(c) for c in FIELDS]).cast(TASK)
    stored = stored.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("tasks"))
    blocks = checkpointed(_blocks(parsed_actions(actions), block))
    rounds = (blocks.agg(F.max("turn").alias("n")).first()["n"] or 0) + 1
    empty = F.array().cast(f"array<{TASK}>")
    start = F.struct(F.coalesce("tasks", empty).alias("tasks"), F.array().cast(f"array<{RESULT}>").alias("out")).cast(STATE)
    after = F.aggregate(F.coalesce("acts", F.array().cast(blocks.schema["acts"].dataType)), start, _step)
    begin = blocks.where("turn = 0 AND part = 0").join(stored, keys, "full").unionByName(blocks.where("turn = 0 AND part > 0"), allowMissingColumns=True)
    out = None
    for n in range(rounds):
        now = begin.select(*keys, "part", "turn", "turns", "first", after.alias("s"))
        if rounds > 1:
            now = checkpointed(now)
        out = now if out is None else out.unionByName(now)
        if n + 1 < rounds:
            begin = blocks.where(F.col("turn") == n + 1).join(now.select(*keys, "part", F.col("s.tasks").alias("tasks")), [*keys, "part"])
    last = F.coalesce(F.col("first") | (F.col("lname") != ""), F.lit(True)) & F.coalesce(F.col("turn") + 1 == F.col("turns"), F.lit(True))
    row = lambda kind, r: F.struct(F.lit(kind).alias("kind"), r["at"], r["intent"], r["status"], r["task"]).cast(ROW)
    shown = lambda r: F.struct(r["at"].alias("at"), r["intent"].alias("intent"), r["status"].alias("status"), F.when(r["status"] != "not_found", r["task"]).alias("task"))
    void = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("intent"), F.lit(None).cast("string").alias("status"))
    kept = F.transform("s.tasks", lambda t: F.struct(F.lit("task").alias("kind"), void["at"], void["intent"], void["status"], t).cast(ROW))
    archived = F.transform(F.filter("s.out", lambda r: r["status"] == "finished"), lambda r: row("archived", r))
    rows = F.concat(F.transform("s.out", lambda r: row("result", shown(r))), archived, F.when(last, kept).otherwise(F.array().cast(f"array<{ROW}>")))
    out = out.select("owner", F.explode(rows).alias("r"))
    return out.select("r.kind", "r.at", "r.intent", "r.status", "owner", *[F.col(f"r.task.{c}").alias(c) for c in FIELDS])
