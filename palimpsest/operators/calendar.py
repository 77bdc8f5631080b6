"""Calendar texts, recurrence and remote tasks."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.text import bound
from palimpsest.operators.tasks import extract_tid, task_upsert
from palimpsest.session import checkpointed

# --- fixed values -----------------------------------------------------------------------------------------
WINDOWS_ZONES = {
    "Eastern Standard Time": "America/New_York",
    "Central Standard Time": "America/Chicago",
    "Mountain Standard Time": "America/Denver",
    "Pacific Standard Time": "America/Los_Angeles",
    "Atlantic Standard Time": "America/Halifax",
    "Newfoundland Standard Time": "America/St_Johns",
    "Alaskan Standard Time": "America/Anchorage",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "GMT Standard Time": "Europe/London",
    "Greenwich Standard Time": "Etc/GMT",
    "W. Europe Standard Time": "Europe/Berlin",
    "Central Europe Standard Time": "Europe/Budapest",
    "Romance Standard Time": "Europe/Paris",
    "E. Europe Standard Time": "Europe/Bucharest",
    "China Standard Time": "Asia/Shanghai",
    "Taipei Standard Time": "Asia/Taipei",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Korea Standard Time": "Asia/Seoul",
    "India Standard Time": "Asia/Kolkata",
    "UTC": "UTC",
    "Coordinated Universal Time": "UTC",
}
LOCAL_ZONE = "America/New_York"
HORIZON_DAYS = 31
DEFAULT_IMPORTANCE = "low"
PRIORITY = {"high": 5, "medium": 3, "low": 1}
ALL_DAY_HOUR = "09:00:00"
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
# -----------------------------------------------------------------------------------------------------------

_KNOWN_ZONES = sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def tz_alias(col) -> Column:
    """Zone name without quotes; Windows names become IANA names."""
    c = F.regexp_replace(F.col(col) if isinstance(col, str) else col, "^[\"']+|[\"']+$", "")
    names = F.create_map(*[F.lit(x) for kv in WINDOWS_ZONES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c), c)


def _zone(col: Column) -> Column:
    """The zone if it is a known one, else null: a bad name must not end the job."""
    return F.when(col.isin(_KNOWN_ZONES), col) if _KNOWN_ZONES else col


def ics_unfold(col) -> Column:
    """Array of logical lines: a line starting with a blank or tab continues the one before."""
    return F.split(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(\r\n|\r|\n)[ \t]", ""), r"\r\n|\r|\n")


def ics_params(head: Column) -> Column:
    """``NAME;K=V;K2=V2`` to a map; a repeated key keeps its last value."""
    bits = F.filter(F.slice(F.split(head, ";"), 2, 1 << 30), lambda b: b.contains("="))
    pairs = F.transform(bits, lambda b: F.struct(F.substring_index(b, "=", 1).alias("k"), F.substr(b, F.position(F.lit("="), b) + 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def ics_datetime(value: Column, params: Column, default_tz: str = "UTC") -> Column:
    """struct<ts, all_day, tz>: instant, whether it is a date, and the zone its local form is shown in."""
    return bound(F.struct(value.alias("v"), params.alias("p")), lambda s: _ics_datetime(s["v"], s["p"], default_tz))


def _ics_datetime(value: Column, params: Column, default_tz: str) -> Column:
    date_only = (F.upper(F.try_element_at(params, F.lit("VALUE"))) == "DATE") | F.regexp_like(value, F.lit(r"^\d{8}$"))
    date_only = F.coalesce(date_only, F.lit(False))
    named = F.try_element_at(params, F.lit("TZID"))
    tz = F.when(named.isNotNull(), _zone(tz_alias(named))).when(~date_only & value.endswith("Z"), "UTC").otherwise(default_tz)
    bare = F.regexp_replace(value, "Z+$", "")
    local = F.when(date_only, F.try_to_timestamp(value, F.lit("yyyyMMdd"))).otherwise(
        F.when(F.length(bare) == 13, F.try_to_timestamp(bare, F.lit("yyyyMMdd'T'HHmm"))).otherwise(F.try_to_timestamp(bare, F.lit("yyyyMMdd'T'HHmmss")))
    )
    shown = F.when(named.isNull() & ~date_only, "UTC").otherwise(tz)
    return F.struct(F.to_utc_timestamp(local, tz).alias("ts"), date_only.alias("all_day"), shown.alias("tz"))


def ics_events(texts: DataFrame, now: Column | None, until: Column | None, key: str = "feed_id", col: str = "text", default_tz: str = "UTC") -> DataFrame:
    """Events of calendar texts that overlap [now, until): (key, pos, summary, start, end, all_day, tz).

    Blocks are cut out of each text and exploded first; the rest works on one event per row.
    """
    joined = F.regexp_replace(col, r"(\r\n|\r|\n)[ \t]", "")
    blocks = F.regexp_extract_all(joined, F.lit(r"(?i)BEGIN:VEVENT([\s\S]*?)END:VEVENT"), F.lit(1))
    ev = texts.select(key, F.posexplode(blocks).alias("pos", "block"))
    out = ev.select(key, "pos", bound(F.split("block", r"\r\n|\r|\n"), lambda lines: _event(lines, default_tz)).alias("e")).select(key, "pos", "e.*")
    out = out.where("start IS NOT NULL AND end IS NOT NULL")
    if until is not None:
        out = out.where(F.col("start") < until)
    return out.where(F.col("end") > now) if now is not None else out


def _property(lines: Column, name: str) -> Column:
    """struct<head, value> of the last line that starts with the property name; value is null when there is none."""
    hit = F.get(F.reverse(F.filter(lines, lambda x: x.startswith(name) & x.contains(":"))), 0)
    return bound(hit, lambda x: F.struct(
        F.substring_index(x, ":", 1).alias("head"), F.nullif(F.trim(F.substr(x, F.position(F.lit(":"), x) + 1)), F.lit("")).alias("value")))


def _event(lines: Column, default_tz: str) -> Column:
    """struct<summary, start, end, all_day, tz, end_tz> of one block; start is null when the block has none."""

    def at(p):
        return F.when(p["value"].isNotNull(), ics_datetime(p["value"], ics_params(p["head"]), default_tz))

    def build(p):
        a, b = p["a"], p["b"]
        # a day later on the local clock, which may be 23 or 25 hours
        next_day = F.to_utc_timestamp(F.from_utc_timestamp(a["ts"], a["tz"]) + F.expr("INTERVAL '1' DAY"), a["tz"])
        end = F.when(b.isNotNull(), b["ts"]).when(a["all_day"], next_day).otherwise(a["ts"] + F.expr("INTERVAL '1' HOUR"))
        return F.struct(
            F.coalesce(p["s"]["value"], F.lit("Untitled")).alias("summary"), a["ts"].alias("start"), end.alias("end"), a["all_day"].alias("all_day"),
            a["tz"].alias("tz"), F.coalesce(b["tz"], a["tz"]).alias("end_tz"),
        )

    parts = F.struct(_property(lines, "SUMMARY").alias("s"), bound(_property(lines, "DTSTART"), at).alias("a"), bound(_property(lines, "DTEND"), at).alias("b"))
    return bound(parts, build)


def feed_tags(tag: Column, tags: Column) -> Column:
    """``tag`` and ``tags`` as one list, blanks and repeats dropped."""
    both = F.concat(F.array(tag), F.coalesce(tags, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda t: t.isNotNull() & (t != "")))


def event_tasks(events: DataFrame, owner: str, seq: Column, tags: Column) -> DataFrame:
    """Events as task rows: local date, times unless all day."""
    at = lambda c, tz, f: F.date_format(F.from_utc_timestamp(F.col(c), F.col(tz)), f)
    name = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit("Untitled"))
    timed = ~F.col("all_day")
    return events.select(
        F.col(owner).alias("owner"), seq.alias("seq"), name.alias("name"), F.lit(DEFAULT_IMPORTANCE).alias("importance"), tags.alias("tags"),
        at("start", "tz", "yyyy-MM-dd").alias("date"), F.when(timed, at("start", "tz", "HH:mm")).alias("start"), F.when(timed, at("end", "end_tz", "HH:mm")).alias("end"),
        F.array().cast("array<string>").alias("updates"),
    )


def events_to_tasks(tasks: DataFrame, events: DataFrame, owner: str, seq: Column, tags: Column) -> DataFrame:
    """Tasks after an upsert of the events; ``action`` gives the insert and update counts."""
    return task_upsert(tasks, checkpointed(event_tasks(events, owner, seq, tags)))


_WHEN = "struct<dateTime:string,date:string,timeZone:string>"


def cal_to_tasks(items: DataFrame, col: str = "item_json", calendar: str = "calendar", owner: str = "owner", seq: str = "seq", tags: list[str] | None = None) -> DataFrame:
    """Calendar-API items as task rows. Times are shown as written, in the event's own offset."""
    item = F.from_json(col, f"struct<summary:string,start:{_WHEN},end:{_WHEN}>")
    i = items.withColumn("_i", item)
    s, e = F.col("_i.start.dateTime"), F.col("_i.end.dateTime")
    mark = F.concat(F.lit("gcal:"), F.regexp_replace(F.lower(calendar), r"\s+", "_"))
    return i.select(
        F.col(owner).alias("owner"), F.col(seq).alias("seq"), F.coalesce(F.nullif(F.trim("_i.summary"), F.lit("")), F.lit("Untitled")).alias("name"),
        F.lit(DEFAULT_IMPORTANCE).alias("importance"), F.array_distinct(F.concat(F.array(*[F.lit(t) for t in tags or []]).cast("array<string>"), F.array(mark))).alias("tags"),
        F.coalesce(F.substring(s, 1, 10), F.col("_i.start.date")).alias("date"), F.substring(s, 12, 5).alias("start"), F.substring(e, 12, 5).alias("end"),
        F.array().cast("array<string>").alias("updates"),
    )


def calendar_select(calendars: DataFrame, targets: list[str]) -> DataFrame:
    """Calendars named in the list, by override or summary; the primary one goes by that name."""
    name = F.coalesce(F.nullif("summary_override", F.lit("")), F.col("summary"))
    prime = F.coalesce("primary", F.lit(False))
    keep = name.isin(targets) | (prime if "primary" in targets else F.lit(False))
    return calendars.where(keep).withColumn("name", F.when(prime, "primary").otherwise(name))


def parse_local_ts(s: Column, tz: Column, fallback: str = LOCAL_ZONE) -> Column:
    """Instant of a date or ISO time: its own offset if it has one, else the task's zone; null when it does not parse."""
    zone = F.coalesce(_zone(F.nullif(tz, F.lit(""))), F.lit(fallback))

    def parse(text):
        own = F.regexp_like(text, F.lit(r"(Z|[+-]\d{2}:\d{2})$"))
        return F.when(own, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone))

    return bound(F.regexp_replace(F.regexp_replace(s, "T", " "), r"([+-]\d{2})(\d{2})$", "$1:$2"), parse)


def _month_later(d: Column) -> Column:
    """A month later by the calendar; a day the month lacks runs over into the next."""
    first = F.add_months(F.trunc(d, "month"), 1)
    return F.date_add(first, F.dayofmonth(d) - 1)


def rrule_next(rrule: Column, anchor: Column, since: Column, tz: Column, mode: str = "reference", max_steps: int | None = None) -> Column:
    """Next occurrence at or after ``since`` for DAILY, WEEKLY (BYDAY) and MONTHLY rules.

    Days and weeks are closed forms on the local clock. After a weekly step BYDAY only moves forward inside the
    week (``mode='rfc'`` visits every listed day). Months are stepped, as an overlong month shifts the day for good.
    ``max_steps`` ends the search after so many periods, possibly before ``since``; the original stops after 512.
    """
    upto = lambda n: n if max_steps is None else F.least(n, F.lit(max_steps))
    rule = F.regexp_replace(F.upper(rrule), "RRULE:", "")
    zone = F.coalesce(_zone(tz), F.lit(LOCAL_ZONE))
    given = F.struct(
        F.regexp_extract(rule, r"(?:^|;)FREQ=([A-Z]+)", 1).alias("freq"), F.regexp_extract(rule, r"(?:^|;)BYDAY=([A-Z,]+)", 1).alias("by"), zone.alias("zone"),
        F.from_utc_timestamp(anchor, zone).alias("a"), F.from_utc_timestamp(since, zone).alias("f"), anchor.alias("anchor"), since.alias("since"),
    )

    def local_days(g):
        clock = F.unix_micros(g["a"]) - F.unix_micros(F.date_trunc("day", g["a"]))
        late = F.unix_micros(g["f"]) - F.unix_micros(F.date_trunc("day", g["f"])) > clock
        # ``want``: first local day on which this clock time is not before ``since``
        want = F.date_add(F.to_date(g["f"]), F.when(late, 1).otherwise(0))
        numbers = F.array(*[F.lit(x) for x in WEEKDAYS])
        listed = F.array_sort(F.filter(F.transform(F.split(g["by"], ","), lambda d: F.array_position(numbers, d) - 1), lambda n: n >= 0))
        return F.struct(g.alias("g"), clock.alias("clock"), F.to_date(g["a"]).alias("day0"), want.alias("want"), listed.alias("listed"))

    def pick(x):
        g, day0, want, listed = x["g"], x["day0"], x["want"], x["listed"]
        gap, w0 = F.datediff(want, day0), F.weekday(day0)
        days = lambda n: F.date_add(day0, n.cast("int"))
        daily = days(upto(F.greatest(gap, F.lit(0))))
        shift = F.when(g["by"] != "", F.coalesce(F.get(F.filter(listed, lambda n: n >= w0), 0) - w0, F.lit(0))).otherwise(0)
        weekly = bound(shift, lambda s: days(upto(F.greatest(F.ceil((gap - s) / 7), F.lit(1))) * 7 + s))
        if mode == "rfc":
            nearest = F.array_min(F.transform(listed, lambda n: F.date_add(want, F.pmod(n - F.weekday(want), F.lit(7)).cast("int"))))
            weekly = F.when((g["by"] != "") & (F.size(listed) > 0), nearest).otherwise(weekly)
        months = upto(F.greatest(F.ceil(F.months_between(want, day0)).cast("int") + 2, F.lit(1)))
        monthly = F.aggregate(F.sequence(F.lit(1), months), day0, lambda d, _: F.when(d < want, _month_later(d)).otherwise(d))
        day = F.when(g["freq"] == "DAILY", daily).when(g["freq"] == "WEEKLY", weekly).when(g["freq"] == "MONTHLY", monthly).otherwise(day0)
        moved = F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + x["clock"]), g["zone"])
        return F.when(g["freq"] == "", F.lit(None).cast("timestamp")).when(g["anchor"] >= g["since"], g["anchor"]).otherwise(moved)

    return bound(bound(given, local_days), pick)


_REMOTE = ("struct<id:string,title:string,status:int,completedTime:string,dueDate:string,dueDateTime:string,startDate:string,startDateTime:string,"
           "timeZone:string,repeatFlag:string,repeat:string,allDay:boolean>")


def remote_tasks(projects: DataFrame, today: Column, col: str = "payload", owner: str = "owner", seq: str = "seq", local_tz: str = LOCAL_ZONE) -> DataFrame:
    """Open tasks of project payloads due from ``today`` (local date) on, as task rows.

    A payload is ``{"name":…, "tasks":[…]}``; tasks are exploded first, so a large project is many rows.
    """
    # one spelling of the zone key: field names are compared without case
    listed = F.regexp_replace(F.get_json_object(col, "$.tasks"), r'"timezone"\s*:', '"timeZone":')
    t = projects.select(F.col(owner).alias("owner"), F.col(seq).alias("seq"), F.get_json_object(col, "$.name").alias("project"),
                        F.posexplode(F.from_json(listed, f"array<{_REMOTE}>")).alias("pos", "t"))
    t = t.where((F.coalesce(F.nullif("t.completedTime", F.lit("")), F.lit("")) == "") & (F.coalesce("t.status", F.lit(0)) == 0))
    tz = F.coalesce("t.timeZone", F.lit(local_tz))
    due_raw, start_raw = F.coalesce("t.dueDate", "t.dueDateTime"), F.coalesce("t.startDate", "t.startDateTime")
    rule = F.nullif(F.coalesce("t.repeatFlag", "t.repeat"), F.lit(""))
    today0 = F.to_utc_timestamp(today.cast("timestamp"), local_tz)
    t = t.withColumn("_tz", tz).withColumn("_raw", F.nullif(due_raw, F.lit(""))).withColumn("_rule", rule)
    t = t.withColumn("_due", parse_local_ts(F.col("_raw"), F.col("_tz"))).withColumn("_start", parse_local_ts(F.nullif(start_raw, F.lit("")), F.col("_tz")))
    again = lambda c: F.when(F.col("_rule").isNotNull() & (F.col(c) < today0), F.coalesce(rrule_next(F.col("_rule"), F.col(c), today0, F.col("_tz")), F.col(c))).otherwise(F.col(c))
    t = t.withColumn("_at", F.coalesce(again("_due"), again("_start"))).where(F.col("_at") >= today0)
    local = F.from_utc_timestamp("_at", local_tz)
    all_day = F.coalesce("t.allDay", F.regexp_like("_raw", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False))
    tag = F.when(F.col("project") != "", F.concat(F.lit("remote:"), F.regexp_replace(F.lower("project"), r"\s+", "_")))
    tags = F.array_distinct(F.filter(F.array(F.lit("remote"), tag, F.when(F.col("_rule").isNotNull(), "recurring")), lambda x: x.isNotNull()))
    return t.select(
        "owner", "seq", "pos", F.coalesce(F.nullif(F.trim("t.title"), F.lit("")), F.lit("Untitled")).alias("name"), F.lit(DEFAULT_IMPORTANCE).alias("importance"),
        tags.alias("tags"), F.date_format(local, "yyyy-MM-dd").alias("date"), F.when(~all_day & F.col("_raw").isNotNull(), F.date_format(local, "HH:mm")).alias("start"),
        F.lit(None).cast("string").alias("end"), F.when(F.coalesce("t.id", F.lit("")) != "", F.array(F.concat(F.lit("TID="), "t.id"))).otherwise(F.array().cast("array<string>")).alias("updates"),
    )


def remote_reconcile(tasks: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, archived): incoming rows with a known TID take the local name and time and unite updates, then upsert;
    local rows whose TID is not in the payload are finished."""
    incoming = checkpointed(incoming)  # parsed and projected once, read by the merge several times
    loc = tasks.withColumn("tid", extract_tid("updates"))
    mine = loc.where("tid IS NOT NULL").groupBy("owner", "tid").agg(F.max_by(F.struct("name", "date", "start", "end", "updates"), "seq").alias("l"))
    inc = incoming.withColumn("tid", extract_tid("updates")).join(mine, ["owner", "tid"], "left")
    known = F.col("l").isNotNull()
    pick = lambda c: F.when(known, F.col(f"l.{c}")).otherwise(F.col(c)).alias(c)
    united = F.when(known, F.array_distinct(F.concat("l.updates", "updates"))).otherwise(F.col("updates"))
    batch = inc.select("owner", "seq", pick("name"), "importance", "tags", pick("date"), pick("start"), pick("end"), united.alias("updates"))
    seen = inc.where("tid IS NOT NULL").select("owner", "tid").distinct()
    lost = loc.where("tid IS NOT NULL").join(seen, ["owner", "tid"], "left_anti")
    after = task_upsert(tasks, batch).join(lost.select("owner", "seq"), ["owner", "seq"], "left_anti")
    return after, lost.drop("tid")


def remote_payload(project_id: str, tid: Column | None = None, tz: str = LOCAL_ZONE) -> Column:
    """Outgoing JSON of a task row: notes without TID lines, UTC times (all-day at 09:00), priority."""
    notes = F.filter(F.coalesce("updates", F.array().cast("array<string>")), lambda u: ~F.regexp_like(F.trim(u), F.lit("(?i)^TID=")))
    d, s, e = F.nullif("date", F.lit("")), F.nullif("start", F.lit("")), F.nullif("end", F.lit(""))
    utc = lambda clock: F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.concat(d, F.lit(" "), clock)), tz), "yyyy-MM-dd'T'HH:mm:ss'+0000'")
    due = F.when(s.isNull(), utc(F.lit(ALL_DAY_HOUR))).when(e.isNotNull(), utc(e)).otherwise(utc(s))
    level = F.lower("importance")
    priority = F.when(level == "high", PRIORITY["high"]).when(level == "medium", PRIORITY["medium"]).when(level == "low", PRIORITY["low"])
    dated = d.isNotNull()
    return F.to_json(F.struct(
        (tid if tid is not None else F.lit(None).cast("string")).alias("id"), F.lit(project_id).alias("projectId"), F.col("name").alias("title"),
        F.when(F.size(notes) > 0, F.array_join(notes, "\n")).alias("content"), F.when(dated & s.isNotNull() & e.isNotNull(), utc(s)).alias("startDate"), due.alias("dueDate"),
        F.when(dated, F.lit(False)).alias("isAllDay"), F.when(dated, F.lit(tz)).alias("timeZone"), F.when(dated, F.array(F.lit("TRIGGER:PT0S"))).alias("reminders"), priority.alias("priority"),
    ))


def remote_find(requests: DataFrame, remote: DataFrame) -> DataFrame:
    """TID of the first open remote task with the request's title and, if both have one, its date prefix."""
    r = requests.select("req_id", F.lower(X.trim_ws("name")).alias("t"), F.coalesce("date", F.lit("")).alias("d"))
    m = remote.where(F.coalesce("status", F.lit(0)) == 0).select(F.lower(X.trim_ws(F.coalesce("title", F.lit("")))).alias("t"), F.coalesce("due_date", F.lit("")).alias("due"), "ord", "tid")
    # one row per title and due date is enough to find the first
    m = m.groupBy("t", "due").agg(F.min(F.struct("ord", "tid")).alias("m"))
    # every beginning of a due date, the empty one too, is an answer of its own: a request meets one row, not all dates of its title
    cuts = F.transform(F.sequence(F.lit(0), F.length("due")), lambda n: F.substring("due", F.lit(1), n))
    starts = m.select("t", F.explode(cuts).alias("d"), "m").groupBy("t", "d").agg(F.min("m").alias("dated"))
    undated = m.where("due = ''").select("t", F.col("m").alias("undated"))
    asked = r.select("t", "d").distinct().join(starts, ["t", "d"], "left").join(undated, "t", "left")
    hit = r.join(asked.select("t", "d", F.least("dated", "undated").alias("m")).where("m IS NOT NULL"), ["t", "d"])
    return hit.groupBy("req_id").agg(F.min("m").alias("m")).select("req_id", F.col("m.tid").alias("tid"))
