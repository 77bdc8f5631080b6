"""Steps whose cost once grew faster than their input, on rows of their own."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import calendar as C
from palimpsest.operators import components as K
from palimpsest.operators import graph as G
from palimpsest.operators import graph_load as L
from palimpsest.operators import neardup as N
from palimpsest.sources import documents as D


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_meet_one_row_of_their_title(spark):
    """A request of a popular title is not joined to every due date of it; the answer is the pairwise one."""
    rng = random.Random(3)
    dates = ["", None, "1998", "1998-01", "1998-01-0", "1998-01-02", "1998-02-01", "19é8-02", "x"]
    reqs = [(rng.choice([None, *range(25)]), rng.choice([" A ", "a", "b", "", None]), rng.choice(dates)) for _ in range(60)]
    rems = [(rng.choice(["A", "a ", "B", None]), rng.choice(dates), rng.choice([0, None, 2]), rng.choice([None, *range(40)]), f"t{i}") for i in range(40)]
    got = C.remote_find(spark.createDataFrame(reqs, "req_id long, name string, date string"), spark.createDataFrame(rems, "title string, due_date string, status int, ord long, tid string"))
    want = {}
    for req, name, d in reqs:
        for title, due, status, at, tid in rems:
            if name is None or (status or 0) != 0 or name.strip().lower() != (title or "").strip().lower() or not ((d or "") == "" or (due or "") == "" or due.startswith(d)):
                continue
            key = (at is not None, at or 0, tid)
            want[req] = min(want.get(req, key), key)
    assert sorted(map(str, got.collect())) == sorted(f"Row(req_id={k}, tid='{v[2]}')" for k, v in want.items())
    assert "StartsWith" not in plan(got)


def test_orphans_parse_a_line_once(spark):
    lines = ['{"rid":"1","type":"t","src":"a","dst":"b"}', '{"rid":"2","type":"","src":"a","dst":"z"}', '{"rid":"2","type":"","src":"a","dst":"z"}', '{"rid":"3","src":"y","dst":"b"}',
             '{"rid":"4","src":"y","dst":"z"}', '{"rid":"5","src":"","dst":"z"}', '{"src":"a","dst":"z"}', "{broken", " \t ", "", None, "[]", "null"]
    rel = D.scan_graph_ndjson(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, line_no long"), "relations")
    assert sorted(r.rid for r in rel.collect()) == ["1", "2", "2", "3", "4"]
    nodes = L.import_nodes(D.scan_graph_ndjson(spark.createDataFrame([('{"nid":"a"}', 0), ('{"nid":"b"}', 1)], "line string, line_no long"), "nodes"))
    edges = L.import_edges(rel)
    out = L.import_orphans(edges, nodes)
    want = {r.id for r in edges.where("rid IN ('2','3','4')").select("id").collect()}
    assert sorted(r.id for r in out.collect()) == sorted(want)
    assert plan(out).count("from_json") == 2  # once for the edges, once for the nodes


def test_a_key_is_indexed_once_however_many_aliases_share_it(spark, tmp_path):
    rows = [(f"a{i}", f"n{i % 7}", f"Red Fox {i % 3}", "s", 1.0 + i % 2, f"red fox {i % 3}") for i in range(90)] + [("z", "nz", None, "s", 1.0, None)]
    aliases = spark.createDataFrame(rows, "id string, node_id string, alias string, source string, weight double, alias_key string")
    path = str(tmp_path / "index")
    G.write_alias_index(aliases, path)
    index = spark.read.parquet(path)
    assert index.where("whole").count() == 90
    assert index.where("NOT whole").groupBy("alias_key", "post").count().where("count > 1").isEmpty()
    terms = spark.createDataFrame([("RED fox 1",), ("fox",), ("ed f",), ("owl",), (None,)], "term string")
    for best in (False, True):
        near = G.touched_aliases(index, terms, best)
        assert sorted(r.id for r in near.collect()) == sorted(r[0] for r in rows[:90])
        got, want = ({(r.term, r.node_id, r.how) for r in G.alias_best(terms, a).collect()} for a in (near, aliases))
        assert got == want
    one = spark.createDataFrame([("red fox 2",)], "term string")  # found by its key: not searched for
    assert {r.alias_key for r in G.touched_aliases(index, one, True).collect()} == {"red fox 2"}
    assert {r.alias_key for r in G.touched_aliases(index, one).collect()} == {"red fox 0", "red fox 1", "red fox 2"}


def test_turns_give_the_greedy_result_with_fewer_pairs(spark, monkeypatch):
    """A dense group meets the few kept of it: its pairs do not grow with the square of its size."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        base = (0x0123456789ABCDEF, 0x7EDCBA9876543210, rng.getrandbits(63))[i % 3]
        rows.append((rng.choice([None, *range(200)]), base ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(3)))))
    df = spark.createDataFrame(rows, "id long, sim long")
    made, sizes = N.near_pairs, []
    monkeypatch.setattr(N, "near_pairs", lambda *a: sizes.append((p := made(*a)).count()) or p)
    got = []
    for first in (20, 10_000):
        sizes.append(0)
        got.append(sorted(map(str, N.dedupe_near(df, ["id"], first=first, grow=2).collect())))
        sizes.append(sum(sizes))
    assert got[0] == got[1] and len(got[0]) > 100
    turns, whole = sizes[: sizes.index(0, 1)], sizes[sizes.index(0, 1) :]
    assert sum(turns[:-1]) * 4 < sum(whole[1:-1])


def test_a_task_holds_few_edges_at_a_time(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        part = K._within_tasks(links, 250)
        assert len({r.b for r in part.collect()}) == 15  # 200 edges at a time
        assert {r.root for r in K.components(links, 250).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
