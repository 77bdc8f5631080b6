"""Calendar texts, recurrence, remote tasks."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import calendar as C
from palimpsest.sources import documents as D

ICS = "\r\n".join([
    "BEGIN:VCALENDAR", "BEGIN:VEVENT", "SUMMARY;LANGUAGE=en:Long", "  title: x", "DTSTART;TZID=Eastern Standard Time:20240310T013000", "DTEND;TZID=America/New_York:20240310T030000", "END:VEVENT",
    "BEGIN:VEVENT", "SUMMARY:", "DTSTART;VALUE=DATE:20240311", "END:VEVENT", "begin:vevent", "SUMMARY:Z", "DTSTART:20240312T1000Z", "end:vevent",
    "BEGIN:VEVENT", "SUMMARY:Float", "DTSTART:20240313T100000", "DTEND:20240313T110000", "END:VEVENT", "BEGIN:VEVENT", "SUMMARY:Bad zone", "DTSTART;TZID=Mars/Base:20240313T100000", "END:VEVENT",
    "BEGIN:VEVENT", "SUMMARY:No start", "END:VEVENT", "END:VCALENDAR"])


def ts(s):
    return F.lit(s).cast("timestamp")


def test_events(spark):
    feed = spark.createDataFrame([(1, ICS)], "feed_id long, text string")
    rows = C.ics_events(feed, None, None).orderBy("pos").collect()
    assert [(r.summary, str(r.start), str(r.end), r.all_day) for r in rows] == [
        ("Long title: x", "2024-03-10 06:30:00", "2024-03-10 07:00:00", False), ("Untitled", "2024-03-11 00:00:00", "2024-03-12 00:00:00", True),
        ("Z", "2024-03-12 10:00:00", "2024-03-12 11:00:00", False), ("Float", "2024-03-13 10:00:00", "2024-03-13 11:00:00", False)]
    # an event ending exactly at now is over; one starting exactly at the horizon is not yet in
    kept = C.ics_events(feed, ts("2024-03-10 07:00:00"), ts("2024-03-13 10:00:00")).orderBy("pos").collect()
    assert [r.summary for r in kept] == ["Untitled", "Z"]
    local = C.ics_events(feed, None, None, default_tz="America/New_York").orderBy("pos").collect()
    assert str(local[1].start) == "2024-03-11 04:00:00" and str(local[3].start) == "2024-03-13 14:00:00"
    tasks = C.event_tasks(C.ics_events(feed, None, None), "feed_id", F.col("pos"), F.array(F.lit("t"))).orderBy("seq").collect()
    assert [(t.date, t.start, t.end) for t in tasks][:2] == [("2024-03-10", "01:30", "03:00"), ("2024-03-11", None, None)]


def nxt(spark, rule, anchor, since, tz="America/New_York", mode="reference", max_steps=None):
    df = spark.createDataFrame([(rule, anchor, since)], "r string, a string, s string")
    got = df.select(C.rrule_next(F.col("r"), F.to_timestamp("a"), F.to_timestamp("s"), F.lit(tz), mode, max_steps).cast("string")).first()[0]
    return got


def test_recurrence(spark):
    assert nxt(spark, "RRULE:FREQ=DAILY", "2024-03-09 15:00:00", "2024-03-11 00:00:00") == "2024-03-11 14:00:00"  # 10:00 in New York across the clock change
    assert nxt(spark, "FREQ=WEEKLY;BYDAY=MO,WE", "2024-01-03 15:00:00", "2024-01-04 00:00:00") == "2024-01-10 15:00:00"  # from a Wednesday: Mondays are skipped
    assert nxt(spark, "FREQ=WEEKLY;BYDAY=MO,WE", "2024-01-03 15:00:00", "2024-01-04 00:00:00", mode="rfc") == "2024-01-08 15:00:00"
    assert nxt(spark, "FREQ=WEEKLY;BYDAY=FR", "2024-01-03 15:00:00", "2024-01-04 00:00:00") == "2024-01-12 15:00:00"
    assert nxt(spark, "FREQ=MONTHLY", "2024-01-31 15:00:00", "2024-02-15 00:00:00") == "2024-03-02 15:00:00"  # no 31 February: two days into March
    assert nxt(spark, "FREQ=MONTHLY", "2024-01-31 15:00:00", "2024-03-15 00:00:00") == "2024-04-02 14:00:00"
    assert nxt(spark, "FREQ=DAILY", "2030-01-01 00:00:00", "2024-01-01 00:00:00") == "2030-01-01 00:00:00"
    assert nxt(spark, "FREQ=DAILY", "2020-01-01 05:00:00", "2024-01-01 00:00:00", "UTC") == "2024-01-01 05:00:00"  # the search goes on until it is there
    assert nxt(spark, "FREQ=DAILY", "2020-01-01 05:00:00", "2024-01-01 00:00:00", "UTC", max_steps=512) == "2021-05-27 05:00:00"  # or ends where asked to
    assert nxt(spark, "COUNT=2", "2020-01-01 05:00:00", "2024-01-01 00:00:00") is None
    assert nxt(spark, "FREQ=YEARLY", "2020-01-01 05:00:00", "2024-01-01 00:00:00") == "2020-01-01 05:00:00"


def test_remote_round(spark):
    pay = {"name": "My List", "tasks": [
        {"id": "AA", "title": " Pay ", "status": 0, "dueDate": "2024-01-10T03:00:00.000+0000", "timezone": "Asia/Tokyo"},
        {"id": "bb", "title": "", "dueDate": "2024-01-10"}, {"id": "cc", "title": "done", "status": 2, "dueDate": "2024-01-10"}, {"id": "dd", "title": "past", "dueDate": "2023-01-10"},
        {"id": "ee", "title": "again", "dueDate": "2023-01-10", "repeatFlag": "RRULE:FREQ=MONTHLY"}, {"id": "ff", "title": "none"}, {"id": "gg", "title": "begin", "startDate": "2024-01-12"}]}
    df = spark.createDataFrame([(1, 1, json.dumps(pay))], "owner long, seq long, payload string")
    inc = C.remote_tasks(df, F.lit("2024-01-09").cast("date"))
    rows = inc.orderBy("pos").collect()
    assert [(r.name, r.date, r.start, r.updates) for r in rows] == [
        ("Pay", "2024-01-09", "22:00", ["TID=AA"]), ("Untitled", "2024-01-10", None, ["TID=bb"]), ("again", "2024-01-10", None, ["TID=ee"]), ("begin", "2024-01-12", None, ["TID=gg"])]
    assert rows[2].tags == ["remote", "remote:my_list", "recurring"]
    local = spark.createDataFrame([(1, 5, "Mine", "high", None, "2024-01-01", None, None, ["TID=aa", "n"]), (1, 6, "Lost", "high", None, None, None, None, ["TID=99"])],
                                  "owner long, seq long, name string, importance string, tags array<string>, date string, start string, end string, updates array<string>")
    after, gone = C.remote_reconcile(local, inc.withColumn("seq", F.col("pos") + 100))
    got = {r.name: (r.date, r.updates, r.action) for r in after.collect()}
    assert got["Mine"] == ("2024-01-01", ["TID=aa", "n", "TID=AA"], "updated") and "Lost" not in got and len(got) == 4
    assert [r.name for r in gone.collect()] == ["Lost"]


def test_payload(spark):
    df = spark.createDataFrame([("A", "High", "2024-07-01", "09:30", "10:00", ["TID=1", "n"]), ("B", None, "2024-07-01", None, None, []), ("C", "x", None, None, None, [])],
                               "name string, importance string, date string, start string, end string, updates array<string>")
    a, b, c = (json.loads(r[0]) for r in df.select(C.remote_payload("p", F.lit("t1"))).collect())
    assert (a["startDate"], a["dueDate"], a["priority"], a["content"]) == ("2024-07-01T13:30:00+0000", "2024-07-01T14:00:00+0000", 5, "n")
    assert b["dueDate"] == "2024-07-01T13:00:00+0000" and "startDate" not in b and "priority" not in b
    assert c == {"id": "t1", "projectId": "p", "title": "C"}


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"tasks": [{"name": "x", "time": {"date": "2024-01-01", "start": ""}, "updates": ["a", "a"]}, {"name": 5}]}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"name": "y"}]))
    (tmp_path / "c.json").write_text('{"tasks": [')
    rows = D.scan_tasks_json(D.read_texts(spark, str(tmp_path)), "path").collect()
    assert sorted((r.name, r.date, r.start, r.updates) for r in rows) == [("5", None, None, []), ("x", "2024-01-01", None, ["a"]), ("y", None, None, [])]
    lines = tmp_path / "n.jsonl"
    lines.write_text('{"nid":"1","labels":["Entity","Person"],"props":{"name":"P"}}\n\n[1]\n{oops\n{"labels":[]}\n')
    got = D.read_graph_ndjson(spark, str(lines), "nodes").collect()
    assert [(r.nid, r.props.name) for r in got] == [("1", "P")]
