"""Projections, filters and per-row decisions over the message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.operators.ordered import cell_scan, first_per_key, id_cell, join_ordered, top_per_key

# --- fixed values -----------------------------------------------------------------------------------------
EPHEMERAL_STARTS = ["task-context:", "```task context policy:", "memories:", "current time is:", "现在时间", "[memory"]
TASK_START, FACT_START, TIME_START, MEMORY_START = "```task context policy:", "memories:", "current time is:", "[Memory v"
DATE_START = r"^(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"
DATE_ANYWHERE = r"^\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
TRACE_START, NUDGE_START = "function result: ", "continue"
# -----------------------------------------------------------------------------------------------------------


def is_ephemeral(content: Column) -> Column:
    """Lines rebuilt on every request: task context, memories, the time, a bare date."""
    low = F.lower(content)
    hit = F.regexp_like(content, F.lit(DATE_START))
    for s in EPHEMERAL_STARTS:
        hit = hit | low.startswith(s)
    return hit


def filter_ephemeral(msgs: DataFrame) -> DataFrame:
    return msgs.where(~((F.col("role") == "system") & is_ephemeral(F.col("content"))))


def filter_first_ephemeral(msgs: DataFrame) -> DataFrame:
    """System rows, less memory blocks and less the first task, facts and time line of each session."""
    low = F.lower("content")
    kind = (
        F.when(low.startswith(TASK_START), "task")
        .when(low.startswith(FACT_START), "facts")
        .when(low.startswith(TIME_START) | F.regexp_like("content", F.lit(DATE_ANYWHERE)), "time")
    )
    rows = msgs.where((F.col("role") == "system") & ~F.col("content").startswith(MEMORY_START)).withColumn("_kind", kind)
    first = rows.where("_kind IS NOT NULL").groupBy("session_id", "_kind").agg(F.min("id").alias("id"))
    return rows.drop("_kind").join(first.select("session_id", "id"), ["session_id", "id"], "left_anti")


def persist_plan(msgs: DataFrame) -> DataFrame:
    """What storing each row would do: insert, or why not."""
    c, role = F.col("content"), F.lower("role")
    trace = (role == "system") & c.startswith(TRACE_START)
    plan = (
        F.when(c == "", "skip_empty")
        .when(trace, "router_trace")
        .when((role == "tool") & F.col("tool_call_id").isNull(), "skip_tool_without_id")
        .when((role == "system") & is_ephemeral(c), "skip_ephemeral")
        .when(role == "assistant", "skip_assistant")
        .otherwise("insert")
    )
    rows = msgs.withColumn("op", plan).withColumn("_mark", F.when(trace, "trace").when((role == "user") & (c != ""), "user"))
    # only traces and user rows matter for the nudge rule: a user row right after a trace among those
    turns = cell_scan(rows.where("_mark IS NOT NULL"), ["session_id"], ["id"], id_cell("id"), lags={"_before": F.col("_mark")})
    nudge = (F.col("_mark") == "user") & (F.col("_before") == "trace") & F.lower("content").startswith(NUDGE_START)
    turns = turns.withColumn("op", F.when(nudge, "skip_nudge").otherwise(F.col("op")))
    return turns.drop("_mark", "_before").unionByName(rows.where("_mark IS NULL").drop("_mark"))


def _last_assistant(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("id"))), F.lit(-1)).alias("_last_a"))


def tail_after_assistant(msgs: DataFrame) -> DataFrame:
    """Rows after the last assistant row of the session."""
    return msgs.join(_last_assistant(msgs), "session_id").where("id > _last_a").drop("_last_a")


def client_delta(msgs: DataFrame, now: Column, tz: str = "-04:00") -> DataFrame:
    """New rows since the last answer, without ephemeral lines; the last user row gets a time stamp."""
    tail = tail_after_assistant(msgs)
    last_user = tail.where("role = 'user'").groupBy("session_id").agg(F.max("id").alias("_last_u"))
    keep = tail.where("content <> ''").where(~((F.col("role") == "system") & is_ephemeral(F.col("content"))))
    stamp = X.stamp_short(F.from_utc_timestamp(now, tz))
    out = keep.join(last_user, "session_id", "left")
    return out.withColumn("content", F.when(F.col("id") == F.col("_last_u"), F.concat(stamp, F.col("content"))).otherwise(F.col("content"))).drop("_last_u")


def tail_user_text(msgs: DataFrame) -> DataFrame:
    tail = tail_after_assistant(msgs).where("role = 'user'").withColumn("t", X.trim_ws("content")).where("t <> ''")
    return tail.groupBy("session_id").agg(join_ordered("t", ["id"], "\n").alias("text"))


def role_runs(msgs: DataFrame) -> DataFrame:
    """User and assistant rows with a flag on the first row of each run of one role."""
    rows = msgs.where(F.col("role").isin("user", "assistant"))
    out = cell_scan(rows, ["session_id"], ["id"], id_cell("id"), lags={"_prev": F.col("role")})
    return out.withColumn("starts", ~F.col("role").eqNullSafe(F.col("_prev"))).drop("_prev")


def alternate_roles(msgs: DataFrame) -> DataFrame:
    """First row of each run of equal roles."""
    out = cell_scan(msgs, ["session_id"], ["id"], id_cell("id"), lags={"_prev": F.col("role")})
    return out.where(~F.col("role").eqNullSafe(F.col("_prev"))).drop("_prev")


def last_k_turns(msgs: DataFrame, k: int = 5, names: dict[str, str] | None = None) -> DataFrame:
    """The newest k turns of each session as ``Tag: text`` lines. Only the k newest run starts are ranked."""
    runs = role_runs(msgs)
    starts = top_per_key(runs.where("starts"), ["session_id"], [F.desc("id")], k)
    since = starts.groupBy("session_id").agg(F.min("id").alias("_since"), F.count(F.lit(1)).alias("turns"))
    rows = runs.join(since, "session_id").where("id >= _since").withColumn("t", X.trim_ws("content"))
    line = F.when(F.col("t") != "", F.concat_ws(": ", X.role_display("role", names), "t"))
    return rows.withColumn("line", line).groupBy("session_id", "turns").agg(join_ordered("line", ["id"], "\n").alias("history"))


def latest_user(msgs: DataFrame) -> DataFrame:
    rows = msgs.where("role = 'user'").withColumn("t", X.trim_ws("content")).where("t <> ''")
    return rows.groupBy("session_id").agg(F.max_by("t", "id").alias("text"))


def role_counts(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def drop_tools(msgs: DataFrame) -> DataFrame:
    return msgs.where("role <> 'tool'").withColumn("tool_calls_json", F.lit(None).cast("string"))


_BLOCKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
_PARTS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])
)


def response_text(response: Column, shape: Column) -> Column:
    """Answer text of a logged API response. ``shape`` is 'blocks', 'output' or 'choices'; '' for others."""
    g = lambda p: F.get_json_object(response, p)
    blocks = F.filter(F.from_json(g("$.content"), _BLOCKS), lambda b: b["type"] == "text")
    from_blocks = F.coalesce(F.get(blocks, 0)["text"], F.lit(""))
    parts = F.from_json(g("$.output"), _PARTS)
    texts = F.filter(F.transform(parts, lambda p: F.coalesce(F.get(p["content"], 0)["text"], p["text"])), lambda t: t.isNotNull())
    from_output = F.coalesce(g("$.output_text"), F.when(parts.isNotNull(), F.array_join(texts, "\n")), response)
    message = lambda k: F.nullif(g(f"$.choices[0].message.{k}"), F.lit(""))
    from_choices = F.coalesce(message("content"), message("reasoning_content"), F.lit(""))
    raw = F.when(shape == "blocks", from_blocks).when(shape == "output", from_output).when(shape == "choices", from_choices).otherwise("")
    return X.sanitize_punct(raw)


CALLS = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])),
        ]
    )
)


def response_tool_calls(response: Column) -> Column:
    """Tool calls of a logged response, or an empty list."""
    return F.coalesce(F.from_json(F.get_json_object(response, "$.content.tool_calls"), CALLS), F.array().cast(CALLS))


def newest_answer(msgs: DataFrame) -> DataFrame:
    """Last assistant row of each session."""
    return first_per_key(msgs.where("role = 'assistant'"), ["session_id"], [F.desc("id")])
