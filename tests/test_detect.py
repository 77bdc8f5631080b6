"""Detection golden rows."""

import json

from pyspark.sql import functions as F

from palimpsest.functions import rules as R
from palimpsest.functions import text as X
from palimpsest.operators import detection as D
from palimpsest.operators import linking as L
from palimpsest.plans.kg_build import kg_build

TODAY = "2025-08-20"  # a Wednesday


def ents(spark, text, today=TODAY):
    rows = spark.createDataFrame([(text,)], "t string").select(R.entities_v0("t", F.lit(today)).alias("e")).first().e
    return [(e.type, e.text, e.norm) for e in rows], [(e.start, e.end) for e in rows]


def test_acceptance_points(spark):
    assert ents(spark, "finish Pici hand analysis by 09/01")[0] == [("Time", "09/01", "2025-09-01")]
    got, spans = ents(spark, "start ‘x’ 'Pici' tomorrow")
    assert got == [("Time", "tomorrow", "2025-08-21"), ("Task", "Pici", "Pici")]
    assert spans[1] == (15, 19)  # bytes: each typographic quote takes three
    assert ents(spark, "32GB RAM in 2 h")[0] == [("Quantity", "32GB", "32 gb"), ("Quantity", "2 h", "2 h")]
    assert ents(spark, "I prefer classical music")[0] == [("Preference", "classical music", "classical music")]
    assert ents(spark, "see you Friday")[0] == [("Time", "Friday", "2025-08-22")]
    assert ents(spark, "on wed")[0] == [("Time", "wed", "2025-08-27")]  # strictly after today
    assert ents(spark, "Meet John Paul Smith2 by 2025-09-03")[0] == [("Time", "2025-09-03", "2025-09-03"), ("Task", "Meet John Paul Smith2", "Meet John Paul Smith2")]


def test_deadline_slot(spark):
    df = spark.createDataFrame([("done by tomorrow",), ("tomorrow",)], "t string")
    got = [r[0] for r in df.select(R.slot_deadline("t", R.entities_v0("t", F.lit(TODAY)))).collect()]
    assert got == ["2025-08-21", None]


def label(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(R.intent_label(X.detector_norm("t"))).collect()]


def test_intents(spark):
    assert label(spark, "finish the report by friday", "I preffer tea", "schedule a call tomorrow", "assign owner Bob", "where is it?", "ok", "安排 会议 明天", "什么") == [
        "plan", "preference", "schedule", "assign", "query", "other", "schedule", "query"]
    assert label(spark, "this is likely") == ["preference"]  # "like" inside "likely"


def test_unicode_word_borders(spark):
    df = spark.createDataFrame([("我们什么时候去",), ("où aller",), ("pour nous",)], "t string")
    assert [r[0] for r in df.select(R.is_question("t")).collect()] == [False, True, False]


def test_names_longest_then_earliest_without_overlap(spark):
    catalog = [
        {"norm": "Ann", "type": "Person", "variants": ["ann lee", "ann"], "word": ("ann",)},
        {"norm": "Lee", "type": "Person", "variants": ["lee"], "word": ()},
    ]
    df = spark.createDataFrame([("annex, Ann Lee and Lee",), ("Anna",)], "t string")
    none = F.array().cast(f"array<{R.ENTITY}>")
    got = [[(e.norm, e.text, e.start) for e in r[0]] for r in df.select(R.inject_names("t", none, catalog)).collect()]
    assert got == [[("Ann", "Ann Lee", 7), ("Lee", "Lee", 19)], []]


def test_detect_with_provider(spark):
    resp = json.dumps({"entities": [{"type": "DATE", "name": "friday", "mentions": [{"text": {"content": "Friday"}}]}, {"type": "WEIRD", "name": "", "salience": 0.1, "mentions": [{"text": {"content": "é"}}]}]})
    df = spark.createDataFrame([("Done by é Friday", resp)], "t string, r string")
    d = D.detect_texts(df, "t", "r").first().det
    assert d.intent.label == "plan" and d.slots == {"deadline": "friday"}
    assert [(e.type, e.norm, e.start, e.end, e.score) for e in d.entities] == [("Time", "friday", 11, 17, 0.5), ("Entity", "é", 8, 10, 0.1)]


def test_historical_suffix(spark):
    d = D.detect_texts(spark.createDataFrame([("I prefer tea",)], "t string"), "t", suffix="-").first().det
    assert d.slots == {"preference": "tea-"}


def det(entities, slots):
    return json.dumps({"intent": {"label": "plan", "score": 0.911}, "entities": entities, "slots": slots})


def test_kg_two_row_batch(spark):
    task = {"type": "Task", "text": "Café Plan", "norm": "Café Plan", "span": [0, 9], "attrs": {}, "score": 0.9}
    again = {**task, "norm": "cafe plan "}
    time = {"type": "Time", "text": "then", "norm": "2025-09-01", "span": [1], "attrs": {"iso": "2025-09-01"}, "score": 0.8}
    weak = {**task, "norm": "weak", "score": 0.1}
    rows = [("s", 1, det([task, time, weak], {"deadline": "2025-09-01"})), ("s", 2, det([again], {})), ("s", 3, "[broken")]
    al = spark.createDataFrame([], "id string, node_id string, alias string, source string, weight double, alias_key string, created_ts timestamp")
    out = kg_build(spark.createDataFrame(rows, "session_id string, msg_id long, det_json string"), al)
    assert sorted((r.type, r.title) for r in out["nodes"].collect()) == [("Task", "Café Plan"), ("Time", "2025-09-01")]
    assert {(r.type) for r in out["edges"].collect()} == {"deadline"}
    assert out["mark"].first().last_id == 3
    rep = {r.msg_id: (r.seeds, r.created, r.matched) for r in L.link_report(out["links"]).collect()}
    assert rep == {1: (2, 2, 0), 2: (1, 0, 1)}
    spans = {r.span_json for r in out["evidence"].collect()}
    assert '{"span":[0,9]}' in spans
    # the same batch against its own result creates nothing
    known = al.select(*al.columns).unionByName(out["aliases"].withColumn("created_ts", F.lit(None).cast("timestamp")))
    assert kg_build(spark.createDataFrame(rows, "session_id string, msg_id long, det_json string"), known)["nodes"].count() == 0


def test_gates(spark):
    rows = [(1, 0, "Task", "Pici", 0, 4, 0.9, "finish Pici"), (2, 0, "Task", "Pici", 7, 11, 0.9, "start ‘Pici’ now"), (3, 0, "Project", "Monday", 0, 6, 0.9, "'Monday'"),
            (4, 0, "Time", "a", 0, 5, 0.5, "x"), (4, 1, "Time", "b", 4, 9, 0.8, "x"), (4, 2, "Time", "c", 9, 12, 0.5, "x"), (4, 3, "Time", "d", 20, 22, 0.3, "x")]
    df = spark.createDataFrame(rows, "msg_id long, pos int, type string, norm string, start int, end int, score double, source_text string")
    assert sorted((r.msg_id, r.norm) for r in D.det_v2_gates(df).collect()) == [(2, "Pici"), (4, "b"), (4, "c")]
