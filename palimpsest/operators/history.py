"""History windows, time-group stamps, tool-call repair and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.messages import CALLS
from palimpsest.operators.ordered import cell_scan, id_cell, top_per_key
from palimpsest.session import checkpointed

PLACEHOLDER = "PLACEHOLDERx"
ROLLING_ROWS, MAX_CONTEXT, RESERVE = 100, 8192, 1024


def last_n_messages(msgs: DataFrame, n: int = 200, per_session: bool = True) -> DataFrame:
    """Newest n (1..1000) user, tool and assistant rows of each session, or of the whole log."""
    n = max(1, min(1000, n))
    rows = msgs.where(F.col("role").isin("user", "tool", "assistant"))
    return top_per_key(rows, ["session_id"], [F.desc("id")], n) if per_session else rows.orderBy(F.desc("id")).limit(n)


def prepare_history(msgs: DataFrame, n: int = ROLLING_ROWS) -> DataFrame:
    """Last n rows with function results masked and tool calls parsed; ``was_trimmed`` when n rows were found."""
    rows = last_n_messages(msgs, n)
    sizes = Window.partitionBy("session_id")  # at most n rows each by now
    calls = F.from_json(F.nullif("tool_calls_json", F.lit("")), CALLS)
    return (
        rows.withColumn("content", X.filter_function_result("content"))
        .withColumn("tool_calls", F.when((F.col("role") == "assistant") & (F.size(calls) > 0), calls))
        .withColumn("tool_call_id", F.when(F.col("role") == "tool", F.nullif("tool_call_id", F.lit(""))))
        .withColumn("was_trimmed", F.count(F.lit(1)).over(sizes) == n)
    )


def group_stamps(msgs: DataFrame, gap_minutes: int = 5, tz: str = "UTC") -> DataFrame:
    """Stamp a row when the day changes or ``gap_minutes`` passed since the last *stamped* row.

    A change of day always stamps, so days of a session are independent and the work is cut by (session, day).
    Within a day only the distinct times matter, and at most 24 h / gap of them are stamped.
    """
    rows = msgs.withColumn("_t", F.date_trunc("second", F.from_utc_timestamp("ts", tz))).withColumn("_day", F.to_date("_t"))
    gap = gap_minutes * 60
    secs = F.unix_timestamp("_t")

    def pick(acc, t):
        take = acc["last"].isNull() | (t - acc["last"] >= gap)
        return F.when(take, F.struct(t.alias("last"), F.concat(acc["picked"], F.array(t)).alias("picked"))).otherwise(acc)

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("picked"))
    times = rows.where("ts IS NOT NULL").groupBy("session_id", "_day").agg(F.array_sort(F.collect_set(secs)).alias("times"))
    picked = times.select("session_id", "_day", F.explode(F.aggregate("times", start, pick, lambda a: a["picked"])).alias("_at"))
    firsts = rows.withColumn("_at", secs).groupBy("session_id", "_day", "_at").agg(F.min("id").alias("id"))
    marks = picked.join(firsts, ["session_id", "_day", "_at"]).select("session_id", "id", F.lit(True).alias("stamped"))
    out = rows.join(marks, ["session_id", "id"], "left").withColumn("stamped", F.coalesce("stamped", F.lit(False)))
    text = F.when(F.col("stamped"), F.concat(X.stamp_short("_t"), F.col("content"))).otherwise(F.col("content"))
    return out.withColumn("content", text).drop("_t", "_day")


def reconcile_tools(msgs: DataFrame) -> DataFrame:
    """Make every assistant row with tool calls be followed by exactly its tool rows, in call order.

    A stretch is a non-tool row and the tool rows after it; stretches are independent. Of the tool rows only
    those that name one of the calls, or name none, can answer a call. Rows come out with ``ord`` to sort by.
    """
    calls = F.filter(F.transform(F.from_json("tool_calls_json", CALLS), lambda c: c["id"]), lambda i: i.isNotNull() & (i != ""))
    rows = cell_scan(msgs, ["session_id"], ["id"], id_cell("id"), sums={"stretch": F.when(F.col("role") != "tool", 1).otherwise(0)})
    # numbered and parsed once, read by every step below
    rows = checkpointed(rows.withColumn("_calls", F.when(F.col("role") == "assistant", F.coalesce(calls, F.array()))))
    heads = rows.where("role <> 'tool'")
    asked = heads.where(F.size("_calls") > 0).select("session_id", "stretch", "_calls")
    given = F.nullif("tool_call_id", F.lit(""))
    answers = rows.where("role = 'tool'").drop("_calls").withColumn("_given", given).join(asked, ["session_id", "stretch"])
    most = asked.agg(F.max(F.size("_calls"))).first()[0] or 0
    unnamed = top_per_key(answers.where("_given IS NULL"), ["session_id", "stretch"], ["id"], max(most, 1))
    named = answers.where(F.array_contains("_calls", F.col("_given")))

    def match(acc, a):
        head = F.get(acc["todo"], 0)
        hit = (F.size(acc["todo"]) > 0) & (a["given"].isNull() | (a["given"] == head))
        return F.when(
            hit,
            F.struct(
                F.slice(acc["todo"], 2, 1 << 30).alias("todo"),
                F.concat(acc["got"], F.array(F.struct(a["id"].alias("id"), head.alias("call")))).alias("got"),
            ),
        ).otherwise(acc)

    begin = F.struct(F.col("_calls").alias("todo"), F.array().cast("array<struct<id:bigint,call:string>>").alias("got"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("_given").alias("given"))))
    folded = unnamed.unionByName(named).groupBy("session_id", "stretch", "_calls").agg(packed.alias("a"))
    folded = folded.select("session_id", "stretch", F.aggregate("a", begin, match).alias("r"))
    got = folded.select("session_id", "stretch", F.explode("r.got").alias("g")).select("session_id", F.col("g.id").alias("id"), F.col("g.call").alias("_call"))
    left = asked.join(folded.select("session_id", "stretch", "r.todo"), ["session_id", "stretch"], "left")
    unmet = left.select("session_id", "stretch", F.posexplode(F.coalesce("todo", "_calls")).alias("_pos", "tool_call_id"))
    cols = ["session_id", "id", "role", "content", "tool_call_id", "tool_calls_json", "ord"]
    order = lambda part, at: F.struct(F.col("stretch"), F.lit(part).alias("part"), at.cast("long").alias("at"))
    kept = heads.withColumn("ord", order(0, F.col("id"))).select(*cols)
    real = rows.join(got, ["session_id", "id"]).withColumn("tool_call_id", F.col("_call")).withColumn("ord", order(1, F.col("id"))).select(*cols)
    fake = unmet.select(
        "session_id", F.lit(None).cast("long").alias("id"), F.lit("tool").alias("role"), F.lit(PLACEHOLDER).alias("content"), "tool_call_id",
        F.lit(None).cast("string").alias("tool_calls_json"), order(2, F.col("_pos")).alias("ord"),
    )
    return kept.unionByName(real).unionByName(fake)


def unique_tool_rows(msgs: DataFrame) -> DataFrame:
    """Drop placeholder rows whose call id also has a real row (rows without an id share one key)."""
    key = F.coalesce("tool_call_id", F.lit(""))
    rows = msgs.withColumn("_k", key)
    real = rows.where(F.col("content") != PLACEHOLDER).select("session_id", "_k").distinct()
    fake = rows.where(F.col("content") == PLACEHOLDER).join(real, ["session_id", "_k"], "left_anti")
    return rows.where(~F.col("content").eqNullSafe(F.lit(PLACEHOLDER))).unionByName(fake).drop("_k")


def latest_summary(msgs: DataFrame) -> DataFrame:
    rows = msgs.where("is_summary")
    best = F.max_by(F.struct("id", "role", "content", "ts"), "id").alias("s")
    return rows.groupBy("session_id").agg(best).select("session_id", "s.*")


def budget_pack(
    msgs: DataFrame, system_rows: DataFrame, max_ctx: int = MAX_CONTEXT, reserve: int = RESERVE, rows: int = ROLLING_ROWS, mode: str = "intended"
) -> DataFrame:
    """System rows while they fit, then the newest history, per session: (section, ord, role, content, tokens).

    ``intended``: history is cut at its old end to fit, and the last summary leads it when rows were cut.
    ``reference``: history is never cut and no summary is added.
    """
    budget = max_ctx - reserve
    sys_rows = system_rows.withColumn("tokens", X.rough_tokens(F.coalesce("content", F.lit(""))))
    sys_rows = cell_scan(sys_rows, ["session_id"], ["ord"], id_cell("ord"), sums={"used": F.col("tokens")}).where(F.col("used") <= budget)
    used = sys_rows.groupBy("session_id").agg(F.max("used").alias("sys_used"))
    hist = prepare_history(msgs, rows).withColumn("tokens", X.rough_tokens("content"))
    hist = hist.join(used, "session_id", "left").fillna(0, ["sys_used"])
    # at most ``rows`` rows per session from here on
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    hist = hist.withColumn("back", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["session_id", "section", "ord", "role", "content", "tokens"]
    system = sys_rows.withColumn("section", F.lit(0)).select(*cols)
    if mode == "reference":
        return system.unionByName(hist.withColumn("section", F.lit(2)).withColumn("ord", F.col("id")).select(*cols))
    fits = hist.where(F.col("sys_used") + F.col("back") <= budget)
    cut = hist.groupBy("session_id", "sys_used").agg(F.max("was_trimmed").alias("trimmed"), F.count(F.lit(1)).alias("n"))
    have = fits.groupBy("session_id").agg(F.count(F.lit(1)).alias("m"), F.max("back").alias("hist_used"))
    state = cut.join(have, "session_id", "left").fillna(0, ["m", "hist_used"]).where("trimmed OR m < n")
    summ = latest_summary(msgs).withColumn("tokens", X.rough_tokens("content")).join(state, "session_id")
    summ = summ.where(F.col("sys_used") + F.col("hist_used") + F.col("tokens") <= budget)
    return (
        system.unionByName(summ.withColumn("section", F.lit(1)).withColumn("ord", F.lit(0).cast("long")).select(*cols))
        .unionByName(fits.withColumn("section", F.lit(2)).withColumn("ord", F.col("id")).select(*cols))
    )


def need_summary(msgs: DataFrame, now: Column, window_rows: int = ROLLING_ROWS, min_turns: int = 40, min_minutes: int = 30) -> DataFrame:
    """Per session: total rows, plain rows, minutes since the last summary, and whether a new one is due."""
    s = F.col("is_summary")
    out = msgs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~s).alias("plain"),
        F.max_by(F.when(s, F.col("ts")), F.when(s, F.col("id"))).alias("last_ts"),
    )
    age = F.floor((F.unix_micros(now) - F.unix_micros("last_ts")) / 60_000_000)
    due = (F.col("total") >= window_rows) & (F.col("last_ts").isNull() | (F.col("age_min") >= min_minutes)) & (F.col("plain") >= min_turns)
    return out.withColumn("age_min", age).withColumn("due", due)


def summary_input(msgs: DataFrame, rows: int = 400) -> DataFrame:
    """Rows to summarise: the previous summary, then the last ``rows`` rows without system rows."""
    last = top_per_key(msgs, ["session_id"], [F.desc("id")], rows).where("role <> 'system'")
    prev = latest_summary(msgs).select("session_id", F.lit(0).cast("long").alias("ord"), F.lit("system").alias("role"), F.concat(F.lit("Previous summary:\n"), "content").alias("content"))
    return prev.unionByName(last.select("session_id", F.col("id").alias("ord"), "role", "content"))


def turn_trigger(msgs: DataFrame, interval: int = 50, per_session: bool = True) -> DataFrame:
    """Every ``interval``-th assistant row that is not a summary."""
    rows = msgs.where("role = 'assistant' AND NOT is_summary")
    keys = ["session_id"] if per_session else []
    rows = rows if keys else rows.withColumn("_all", F.lit(1))
    out = cell_scan(rows, keys or ["_all"], ["id"], id_cell("id"), rank="turn_no")
    return out.where(F.col("turn_no") % interval == 0)


def diary_window(msgs: DataFrame, triggers: DataFrame, rows: int = 135) -> DataFrame:
    """The last ``rows`` prepared rows up to each trigger."""
    numbered = cell_scan(msgs.where(F.col("role").isin("user", "tool", "assistant")), ["session_id"], ["id"], id_cell("id"), rank="n")
    at = triggers.select("session_id", F.col("id").alias("trigger_id")).join(
        numbered.select("session_id", F.col("id").alias("trigger_id"), "n"), ["session_id", "trigger_id"]
    )
    wanted = at.select("session_id", "trigger_id", F.explode(F.sequence(F.greatest(F.col("n") - rows + 1, F.lit(1)), F.col("n"))).alias("n"))
    return wanted.join(numbered, ["session_id", "n"])
