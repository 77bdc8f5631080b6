"""Task tables: rows (owner, seq, name, importance, tags, date, start, end, updates); ``seq`` is the list order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.ordered import cell_scan, id_cell, top_per_key

# --- fixed values -----------------------------------------------------------------------------------------
CAPS = {"past": 8, "present": 45, "future": 20}
CAPS_V1 = {"past": 8, "present": 10, "future": 8}
PRESENT_DAYS = 15
POLICY = "Task context policy: past & future, names only; present(in 15d) full info."
HEADS = {"past": "Past:", "present": "Present (next 15 days):", "future": "Future:"}
EMPTY_DIGEST = "task-context: empty"
# -----------------------------------------------------------------------------------------------------------

FIELDS = ["name", "importance", "tags", "date", "start", "end"]


def _z(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def task_key(name="name", date="date", start="start", end="end") -> Column:
    """lower(trim(name))|date|start|end."""
    return F.concat_ws("|", F.lower(X.trim_ws(_z(name))), _z(date), _z(start), _z(end))


def task_normalize(tasks: DataFrame) -> DataFrame:
    """Strings throughout, empty times as null, updates unique in order."""
    return (
        tasks.withColumn("name", _z("name"))
        .withColumn("importance", F.col("importance").cast("string"))
        .withColumn("tags", F.col("tags").cast("array<string>"))
        .withColumn("date", F.col("date").cast("string"))
        .withColumn("start", F.nullif(F.col("start").cast("string"), F.lit("")))
        .withColumn("end", F.nullif(F.col("end").cast("string"), F.lit("")))
        .withColumn("updates", F.array_distinct(F.filter(F.coalesce("updates", F.array().cast("array<string>")), lambda u: u.isNotNull())))
    )


def task_upsert(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or merge by (owner, key): the last row's fields win, updates are united in order.

    A batch may carry many rows per key. Updates are made unique before they are gathered, so a key written
    a million times with few distinct notes stays small. ``action`` tells inserted, updated or kept.
    """
    cols = ["owner", "seq", *FIELDS, "updates"]
    rows = task_normalize(target.select(*cols)).withColumn("gen", F.lit(0)).unionByName(task_normalize(batch.select(*cols)).withColumn("gen", F.lit(1)))
    rows = rows.withColumn("key", task_key())
    # stored rows may repeat a key; only the first of them is merged into, the rest stay
    first = rows.where("gen = 0").groupBy("owner", "key").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, ["owner", "key"], "left")
    extra = rows.where("gen = 0 AND seq > _first").select(*cols, F.lit("kept").alias("action"))
    rows = rows.where("gen = 1 OR seq = _first")
    order = F.struct("gen", "seq")
    last = rows.groupBy("owner", "key").agg(
        F.max_by(F.struct(*FIELDS), order).alias("f"), F.min(order).alias("o"), F.max("gen").alias("g1"), F.min("gen").alias("g0")
    )
    notes = rows.select("owner", "key", "gen", "seq", F.posexplode("updates").alias("pos", "u"))
    notes = notes.groupBy("owner", "key", "u").agg(F.min(F.struct("gen", "seq", "pos")).alias("o"))
    notes = notes.groupBy("owner", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "u"))), lambda x: x["u"]).alias("updates"))
    action = F.when(F.col("g0") == 1, "inserted").when(F.col("g1") == 1, "updated").otherwise("kept")
    out = last.join(notes, ["owner", "key"], "left").select(
        "owner", F.col("o.seq").alias("seq"), "f.*", F.coalesce("updates", F.array().cast("array<string>")).alias("updates"), action.alias("action")
    )
    return out.unionByName(extra)


def _same(req: str, have: str, loose: bool) -> Column:
    r, h = F.col(f"r.{req}"), _z(F.col(f"t.{have}"))
    ok = r.isNull() | (h == r)
    return (ok | (h == "")) if loose else ok


def _matches(tasks: DataFrame, requests: DataFrame, loose: bool = False) -> Column:
    return (
        (F.col("t.owner") == F.col("r.owner")) & (F.lower("t.name") == F.lower(X.trim_ws(F.col("r.name"))))
        & _same("date", "date", loose) & _same("start", "start", loose) & _same("end", "end", loose)
    )


def task_find(tasks: DataFrame, requests: DataFrame, loose: bool = False) -> DataFrame:
    """First task for each request (req_id, owner, name, date, start, end); a null in a request matches anything.

    ``loose`` also lets an empty field of the task match.
    """
    same = ["owner", F.lower("name").alias("name"), "date", "start", "end"]
    firsts = tasks.groupBy(*same).agg(F.min("seq").alias("seq"))
    hit = requests.alias("r").join(firsts.alias("t"), _matches(firsts, requests, loose)).groupBy("r.req_id", "r.owner").agg(F.min("t.seq").alias("seq"))
    return hit.join(tasks, ["owner", "seq"])


def task_append_update(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """Append ``note`` of each request to its first match; blanks are dropped and lines stay unique."""
    found = task_find(tasks, notes).select("req_id", "owner", "seq").join(notes.select("req_id", "note"), "req_id").where("note <> ''")
    lines = found.groupBy("owner", "seq", "note").agg(F.min("req_id").alias("o")).groupBy("owner", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "note"))), lambda x: x["note"]).alias("new"))
    out = tasks.join(lines, ["owner", "seq"], "left")
    united = F.array_distinct(F.filter(F.concat(F.coalesce("updates", F.array().cast("array<string>")), F.col("new")), lambda u: u != ""))
    return out.withColumn("updates", F.when(F.col("new").isNotNull(), united).otherwise(F.col("updates"))).drop("new")


def task_delete(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tasks left after removing every match of every request."""
    return tasks.alias("t").join(requests.alias("r"), _matches(tasks, requests), "left_anti")


def task_finish(tasks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): each request removes its first match; equal requests take the following matches in turn.

    Requests with different filters see the table as it was before the batch; ordered mixes go through ``actions_apply``.
    """
    keys = ["owner", "lname", "date", "start", "end"]
    req = requests.withColumn("lname", F.lower(X.trim_ws("name"))).withColumn("kind", F.to_json(F.struct(*keys)))
    # the n-th request of a kind takes its n-th match: both are numbered in cells, so a hot name is spread over tasks
    asked = cell_scan(req.select("req_id", "kind"), ["kind"], ["req_id"], id_cell("req_id"), rank="nth")
    kinds = req.select(*keys, "kind").distinct().withColumnRenamed("lname", "name")
    hits = kinds.alias("r").join(tasks.alias("t"), _matches(tasks, kinds)).select("r.kind", "t.owner", "t.seq")
    hits = cell_scan(hits, ["kind"], ["seq"], id_cell("seq"), rank="nth")
    taken = asked.join(hits, ["kind", "nth"]).groupBy("owner", "seq").agg(F.min("req_id").alias("req_id"))
    return tasks.join(taken, ["owner", "seq"], "left_anti"), tasks.join(taken, ["owner", "seq"])


def with_sort(tasks: DataFrame) -> DataFrame:
    """``place`` of each task in its owner's list: dated first, by date and start; undated keep their order."""
    d = F.nullif("date", F.lit(""))
    t = tasks.withColumn("_d", F.coalesce(d, F.lit("~"))).withColumn("_s", F.when(d.isNull(), "").otherwise(F.coalesce("start", F.lit("00:00"))))
    return cell_scan(t, ["owner"], ["_d", "_s", "seq"], F.col("_d"), rank="place").drop("_d", "_s")


def task_bucket(today, date="date") -> Column:
    """past, present (up to 15 days ahead) or future; undated tasks are future."""
    t = F.to_date(F.lit(today)) if isinstance(today, str) else today
    d = F.to_date(F.nullif(F.col(date), F.lit("")))
    return F.when(d < t, "past").when(d <= F.date_add(t, PRESENT_DAYS), "present").otherwise("future")


def task_digest(tasks: DataFrame, today, style: str = "v2", caps: dict[str, int] | None = None) -> DataFrame:
    """One text per owner: past and future by name, present in full; capped per section."""
    caps = caps or (CAPS if style == "v2" else CAPS_V1)
    d, s = F.nullif("date", F.lit("")), F.nullif("start", F.lit(""))
    order = [F.when(d.isNull(), "~").otherwise(d), F.when(d.isNull(), "").otherwise(F.coalesce("start", F.lit("00:00"))), "seq"]
    rows = tasks.withColumn("bucket", task_bucket(today))
    rows = top_per_key(rows, ["owner", "bucket"], order, max(caps.values()), rank="place")
    cap = F.when(F.col("bucket") == "past", caps["past"]).when(F.col("bucket") == "present", caps["present"]).otherwise(caps["future"])
    rows = rows.where(F.col("place") <= cap)
    span = F.when(s.isNotNull(), F.concat(F.lit(" "), s, F.when(F.nullif("end", F.lit("")).isNotNull(), F.concat(F.lit("-"), F.col("end"))).otherwise("")))
    imp = F.nullif("importance", F.lit(""))
    if style == "v2":
        when = F.concat(d, F.coalesce(span, F.lit("")), F.date_format(F.to_date(d), "' ('EEE')'"))
        full = F.concat(F.lit("["), when, F.lit("] "), F.coalesce(F.concat(F.lit("("), imp, F.lit(") ")), F.lit("")), F.col("name"))
    else:
        full = F.trim(F.concat(F.coalesce(F.concat(F.lit("["), imp, F.lit("] ")), F.lit("")), F.col("name"), F.lit(" - "), d, F.coalesce(span, F.lit(""))))
    last2 = F.slice("updates", F.greatest(F.size("updates") - 1, F.lit(1)), 2)
    notes = F.when(F.size("updates") > 0, F.concat(F.lit(" Updates: "), F.array_join(last2, "; "))).otherwise("")
    line = F.concat(F.lit("- "), F.when(F.col("bucket") == "present", F.concat(full, notes)).otherwise(F.col("name")))
    # at most the caps' sum of lines per owner
    part = lambda b: F.array_join(F.transform(F.filter(F.col("l"), lambda x: x["b"] == b), lambda x: x["line"]), "\n")
    per = rows.withColumn("line", line).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("b"), "place", "line"))).alias("l"))
    body, shown = [], {}
    for b in ("past", "present", "future"):
        has = F.exists("l", _is_bucket(b))
        shown[b] = has
        gap = F.lit("")
        if b == "present":
            gap = F.when(shown["past"], "\n").otherwise("")
        elif b == "future":
            gap = F.when(shown["present"], "\n").otherwise("")
        body.append(F.when(has, F.concat(gap, F.lit(HEADS[b] + "\n"), part(b))))
    text = F.concat_ws("\n", *body)
    digest = F.concat(F.lit(POLICY + "\n```"), text, F.lit("```")) if style == "v2" else F.concat(F.lit("```" + POLICY + "\n"), text, F.lit("```"))
    return per.select("owner", digest.alias("digest"))


def _is_bucket(b: str):
    return lambda x: x["b"] == b


def digest_or_default(owners: DataFrame, digests: DataFrame) -> DataFrame:
    """Every owner with a digest, or the fixed text when there is none."""
    return owners.select("owner").distinct().join(digests, "owner", "left").withColumn("digest", F.coalesce("digest", F.lit(EMPTY_DIGEST)))


def extract_tid(updates) -> Column:
    """First ``TID=hex`` line of the updates, lower case."""
    hits = F.filter(F.transform(updates, lambda u: F.regexp_extract(X.trim_ws(u), r"(?i)^TID=([a-f0-9]+)$", 1)), lambda t: t != "")
    return F.lower(F.get(hits, 0))


