"""Hit selection and transcripts against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import retrieval as R

NOW = 1706745600  # 2024-02-01


def walk(hits, rmin=0, rmax=3):
    top = max(h[1] for h in hits) or 1e-9
    prev, chosen = top, []
    for i, s, age in hits:
        if s < 0.01:
            break
        rec = 0.5 if age is None else 0.5 ** (max(age, 0) / 168)
        drop = max((prev - s) / max(prev, 1e-9), 0)
        comp = round(0.7 * max(min(s / top, 1), 0) + 0.25 * rec - 0.2 * drop, 9)
        if len(chosen) < rmin or comp >= 0.35:
            chosen.append((comp, i))
            prev = s
        elif drop >= 0.25 and len(chosen) >= rmin:
            break
        if len(chosen) >= rmax:
            break
    return [i for _, i in sorted(chosen, key=lambda c: -c[0])]


def test_select_hits_equals_walk(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        scores = sorted((round(rng.choice([rng.random(), 0.5, 0.005]), 3) for _ in range(8)), reverse=True)
        hits = [(i, s, rng.choice([None, rng.randint(-5, 500)])) for i, s in enumerate(scores)]
        want[q] = walk(hits)
        rows += [(q, i, s, i + 1, None if a is None else NOW - a * 3600) for i, s, a in hits]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, rank int, t long").withColumn("start_ts", F.timestamp_seconds("t"))
    got = {q: [] for q in want}
    for r in R.select_hits(df, F.timestamp_seconds(F.lit(NOW))).orderBy("query_id", "place").collect():
        got[r.query_id].append(r.id)
    assert got == want


def test_no_room_still_takes_one(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], "query_id long, id long, score double, rank int").withColumn("start_ts", F.lit(None).cast("timestamp"))
    assert [r.id for r in R.select_hits(df, F.timestamp_seconds(F.lit(NOW)), rmax=0).collect()] == [1]


def test_topk_in_several_blocks(spark):
    rng = np.random.default_rng(1)
    v = [(int(i), rng.normal(size=8).tolist()) for i in range(300)]
    vec = spark.createDataFrame(v, "id long, vector array<double>").repartition(5)
    q = vec.where("id < 40").withColumnRenamed("id", "query_id")
    got = R.vector_topk(q, vec, 7, block=8).orderBy("query_id", "rank").collect()
    mat = np.array([x[1] for x in v])
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    for qid in range(40):
        sims = np.round(mat @ mat[qid], 6)
        want = sorted(range(300), key=lambda i: (-sims[i], i))[:7]
        assert [r.id for r in got if r.query_id == qid] == want


def test_merge_lines_drops_close_stamps(spark):
    rows = [(1, "2024-01-01 10:06:00", 1, "[240101Mon 10:06] User: c"), (1, "2024-01-01 10:00:00", 0, "[240101Mon 10:00] User: a\n\n[240101Mon 10:03] Assistant: b")]
    df = spark.createDataFrame(rows, "query_id long, t string, place int, chunk_text string").withColumn("start_ts", F.to_timestamp("t"))
    assert R.merge_hit_lines(df).first().text == "[240101Mon 10:00] User: a\nAssistant: b\n[240101Mon 10:06] User: c"


def test_unpack_and_dedupe(spark):
    text = "[Memory v2] lost\n[240101Mon 10:00] User: a\nmore  x\nAssistant: b\nmore x\n[240101Mon 10:09] User: a"
    rows = R.unpack_transcript(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t")
    assert [(r.role, r.content) for r in rows.orderBy("msg_no").collect()] == [("user", "[240101Mon 10:00] a\nmore  x"), ("assistant", "b\nmore x"), ("user", "[240101Mon 10:09] a")]
    out = R.dedupe_lines(rows, "k").orderBy("msg_no").collect()
    assert [(r.role, r.content) for r in out] == [("user", "[240101Mon 10:00] a\nmore  x"), ("assistant", "b")]


def test_memory_cap(spark):
    assert spark.range(1).select(R.memory_cap(F.lit("x" * 7000))).first()[0] == "[Memory v2] " + "x" * 5988


def nearest(queries, vectors, k):
    """(query_id, id, rank) by the full cosine, pair by pair."""
    out = []
    unit = lambda v: np.array(v, float) / max(np.sqrt((np.array(v, float) ** 2).sum()), 1e-300)
    ok = [(i, v) for i, v in vectors if v is not None and None not in v]
    for q, v in queries:
        if v is None or None in v:
            continue
        scores = sorted((-round(float((unit(v) * unit(w)).sum()), 12), i) for i, w in ok if len(w) == len(v))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(scores[:k])]
    return sorted(out)


def test_vector_topk_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(f"v{i:04d}", (centres[i % 12] + rng.normal(size=16) * 0.2).tolist()) for i in range(1500)]
    rows += [(f"t{i:03d}", rows[5][1]) for i in range(40)]  # equal vectors: ties by id
    rows += [("zero", [0.0] * 16), ("null", None), ("hole", [None] * 16), ("short", [1.0, 2.0])]
    asked = [(i, rows[i * 7][1]) for i in range(100)] + [(1000, [0.0] * 16), (1001, None), (1002, [2.0, 1.0]), (1003, rows[5][1])]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    want = nearest(asked, rows, 5)
    for sizes in ({}, {"block": 7, "rows": 40}, {"planes": 1, "rows": 25}):
        got = R.vector_topk(q, v, 5, **sizes).collect()
        assert sorted((r.query_id, r.id, r["rank"]) for r in got) == want
    assert all(r.score == round(r.score, 6) for r in got)
    share = R.skipped_share(q.where("query_id < 1000"), v.where("id <> 'zero'"), 5, rows=40, planes=6).first()
    assert share.pairs > 1000 and share.skipped > 0.5 * share.pairs  # near vectors share blocks, far blocks are left out


def test_near_ties_are_ranked_by_the_full_score(spark):
    v = spark.createDataFrame([(1, [1.0, 2e-4]), (2, [1.0, 1e-4])], "id long, vector array<double>")  # equal to six places
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.id, r.score) for r in R.vector_topk(q, v, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 1.0)]


def test_vector_topk_of_nothing(spark):
    v = spark.createDataFrame([], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert R.vector_topk(q, v).collect() == [] and R.vector_topk(q.where("false"), q.withColumnRenamed("query_id", "id")).collect() == []


def test_a_query_meets_few_tiles_of_a_cell():
    """Scored slice by slice, the best of a tile are those of one product, ties included."""
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(6, 4)), rng.normal(size=(53, 4))
    x[40] = x[7]
    for k, rows in ((5, 10), (60, 10), (1, 53)):
        whole, sliced = R._best(q, x, k), R._best_of(q, x, k, rows)
        for i in range(len(q)):
            at = np.sort((q[i] * x).sum(axis=1))[::-1][: min(k, len(x))]
            assert sorted(sliced[2][sliced[0] == i])[::-1][: len(at)] == at.tolist()
            assert set(sliced[1][sliced[0] == i]) == set(whole[1][whole[0] == i])


def test_pairs_grow_with_tiles_not_blocks(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    share = R.skipped_share(q, v, 3, rows=10, planes=1).first()
    assert share.pairs <= 400 * 2 * 4  # 40 blocks of 10 lie in two cells
