"""The paths for hot keys give the same rows as the plain ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import chunks as C
from palimpsest.operators import graph as G
from palimpsest.operators import neardup as N
from palimpsest.operators.components import components
from palimpsest.operators.ordered import cell_scan, id_cell, top_per_key
from palimpsest.session import checkpointed


def test_cell_scan_equals_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.randint(0, 9), rng.choice(["x", "y", None])) for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, id long, v int, r string")
    got = cell_scan(df, ["k"], ["id"], id_cell("id", 37), rank="n", sums={"s": F.col("v")}, lags={"p": F.col("r")})
    w = Window.partitionBy("k").orderBy("id")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("s", F.sum("v").over(w)).withColumn("p", F.lag("r").over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_top_per_key_salted(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    got = top_per_key(df, ["k"], [F.desc("id")], 1500)
    assert got.groupBy("k").agg(F.count("*"), F.min("id")).orderBy("k").collect() == [(0, 1500, 2000), (1, 1500, 2001)]


def sentence_rows(n, seed):
    rng = random.Random(seed)
    return [("s", i, i * 61, 0, "u", "w" * rng.choice([1, 3, 9, 17, 60])) for i in range(n)]


def test_blocked_chunks_equal_whole(spark):
    sents = spark.createDataFrame(sentence_rows(900, 2), "session_id string, id long, t long, pos int, role string, text string")
    sents = sents.withColumn("ts", F.timestamp_seconds("t")).drop("t").withColumn("len", F.length("text"))
    cols = ["chunk_ord", "first", "last", "chars", "raw_text"]
    whole = C.slide_chunks(sents, 30, 8).select(cols).orderBy("chunk_ord").collect()
    assert C.slide_chunks(sents, 30, 8, block=32).select(cols).orderBy("chunk_ord").collect() == whole
    covered = {n for r in whole for n in range(r["first"], r["last"] + 1)}
    assert covered == set(range(900))


def test_numbers_do_not_depend_on_ids_or_stamps(spark):
    rng = random.Random(9)
    sparse = rng.sample(range(1 << 60), 3000)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, t, p) for i in sparse[:1500] for t in (0,) for p in (0, 1)]  # one stamp, ids far apart
    rows += [("late", i, i % 5 * 10**6, 0) for i in sparse[1500:]]
    df = spark.createDataFrame(rows, "session_id string, id long, t long, pos int").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.session_id, r.id, r.pos): r.n for r in C.number_sentences(df).collect()}
    want = {}
    for s in ("hot", "a", "late"):
        own = sorted((t, i, p) for k, i, t, p in rows if k == s)
        want |= {(s, i, p): n for n, (t, i, p) in enumerate(own)}
    assert got == want and C.number_sentences(df.limit(0)).collect() == []


def test_sessions_of_one_and_of_many_blocks_together(spark):
    rows = [(f"s{k}", i, i * 61, 0, "u", "w" * (1 + (i * 7 + k) % 23)) for k, n in enumerate((1, 31, 32, 33, 64, 65, 300)) for i in range(n)]
    sents = spark.createDataFrame(rows, "session_id string, id long, t long, pos int, role string, text string")
    sents = sents.withColumn("ts", F.timestamp_seconds("t")).drop("t").withColumn("len", F.length("text"))
    cols = ["session_id", "chunk_ord", "first", "last", "chars", "raw_text"]
    whole = C.slide_chunks(sents, 30, 8).select(cols).orderBy("session_id", "chunk_ord").collect()
    assert C.slide_chunks(sents, 30, 8, block=32).select(cols).orderBy("session_id", "chunk_ord").collect() == whole
    assert {r.session_id for r in whole} == {f"s{k}" for k in range(7)}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # blocks reach over many batches
    try:
        assert C.slide_chunks(sents, 30, 8, block=32).select(cols).orderBy("session_id", "chunk_ord").collect() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_block_entries_compose_in_stretches(spark):
    sents = spark.createDataFrame(sentence_rows(700, 3), "session_id string, id long, t long, pos int, role string, text string")
    sents = sents.withColumn("ts", F.timestamp_seconds("t")).withColumn("len", F.length("text"))
    numbered = checkpointed(C.number_sentences(sents))
    lens = C._blocked(numbered, 30, 32).select("session_id", "block", "n", "len")
    maps = checkpointed(lens.groupBy("session_id", "block").applyInPandas(C._block_maps(30, 8, 32), "session_id string, block long, entry long, exit long, chunks long"))
    a = C._block_entries(maps, fan=1000).orderBy("block").collect()
    assert C._block_entries(maps, fan=3).orderBy("block").collect() == a


def greedy(sims):
    kept = []
    for s in sims:
        if all(((s ^ k) & (2**64 - 1)).bit_count() > 3 for k in kept):
            kept.append(s)
    return kept


def test_near_dup_equals_sequential_greedy(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    sims = []
    for _ in range(400):
        s = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            s ^= 1 << rng.randint(0, 63)
        sims.append(s - 2**64 if s >= 2**63 else s)
    df = spark.createDataFrame(list(enumerate(sims)), "id long, sim long")
    want = sorted(greedy(sims))
    for hot in (2000, 8):  # 8: nearly every band is refined
        assert sorted(r[0] for r in N.dedupe_near(df, ["id"], hot=hot).select("sim").collect()) == want
    assert max(r["count"] for r in N.band_keys(df.select("sim").distinct(), hot=8).groupBy("band").count().collect()) < 60


def test_near_dup_chain_and_borders(spark):
    a, b, c = 0, 0b111, 0b111111  # a~b, b~c, a and c differ in 6 bits
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, 0b1111 << 40), (5, 0b111 << 50), (6, a)], "id long, sim long")
    assert sorted(r[0] for r in N.dedupe_near(df, ["id"]).select("id").collect()) == [1, 3, 4]


def test_drop_known(spark):
    new = spark.createDataFrame([(1, 0b1), (2, 0b11111 << 20)], "id long, sim long")
    old = spark.createDataFrame([(0,)], "sim long")
    assert [r.id for r in N.drop_known(new, old).collect()] == [2]


def test_hub_neighbours_are_cut_without_changing_levels(spark):
    rng = random.Random(5)
    edges = [(f"e{i}", "hub", f"n{i:03d}", "t", rng.randint(1, 9) / 10) for i in range(300)] + [("x", "s", "hub", "t", 0.5)]
    e = spark.createDataFrame(edges, "id string, src_id string, dst_id string, type string, weight double")
    seeds = spark.createDataFrame([(1, "s")], "query_id long, node_id string")
    got = {(r.node_id, r.depth) for r in G.khop_expand(seeds, e, 2, 10).collect()}
    best = sorted(edges[:300], key=lambda r: (-r[4], r[2]))[:10]
    assert got == {("s", 0), ("hub", 1)} | {(r[2], 2) for r in best}


def test_substring_search_equals_scan(spark):
    rng = random.Random(6)
    al = [(f"n{i}", f"a{i}", "".join(rng.choice("abc ") for _ in range(8)), 1.0) for i in range(200)]
    df = spark.createDataFrame(al, "node_id string, id string, alias string, weight double").withColumn("alias_key", F.lower("alias"))
    terms = ["a", "bc", "abc", "cab ", "%", "zzz"]
    got = {(r.term, r.id) for r in G.containing(spark.createDataFrame([(t,) for t in terms], "term string"), df).collect()}
    assert got == {(t, a[1]) for t in terms for a in al if t.strip() in a[2]}


def test_rounds_do_not_grow_with_a_chain(spark, monkeypatch):
    rng = random.Random(2)
    made, calls = N.checkpointed, []
    monkeypatch.setattr(N, "checkpointed", lambda df: calls.append(1) or made(df))
    used = []
    for n in (50, 1000):
        sims = [rng.getrandbits(64)]
        while len(sims) < n:  # two more bits each time, and again others: a link to the one before, few to others
            sims.append(sims[-1] ^ sum(1 << b for b in rng.sample(range(64), 2)))
        sims = [s - 2**64 if s >= 2**63 else s for s in dict.fromkeys(sims)]
        df = spark.createDataFrame(list(enumerate(sims)), "id long, sim long")
        calls.clear()
        assert sorted(r[0] for r in N.dedupe_near(df, ["id"]).select("sim").collect()) == sorted(greedy(sims))
        used.append(len(calls))
    assert used[0] == used[1]


def test_large_components_are_settled_by_rounds(spark):
    rng = random.Random(8)
    links = {(b, a) for a, b in (sorted(rng.sample(range(100), 2)) for _ in range(120))} | {(i + 1, i) for i in range(1000, 1040)}
    pairs = spark.createDataFrame(sorted(links), "sim long, earlier long").repartition(3)
    firsts = spark.createDataFrame([(i,) for i in [*range(100), *range(1000, 1041), 5000]], "sim long")
    kept = []
    for x in [*range(100), *range(1000, 1041), 5000]:
        if not any((x, k) in links for k in kept):
            kept.append(x)
    for limit in (1_000_000, 50):
        assert sorted(r.sim for r in N.greedy_keep(firsts, pairs, limit).collect()) == kept


def test_components_over_several_tasks(spark):
    links = [(i, i + 1) for i in range(0, 80)] + [(200, 500), (500, 300), (7, 7), (None, 3)] + [(900, 900 + i) for i in range(1, 30)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    want = {i: 0 for i in range(81)} | {200: 200, 300: 200, 500: 200} | {900 + i: 900 for i in range(30)}
    for few in (50, 100_000):
        assert {r.node: r.root for r in components(df, few).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_are_cut_until_none_is_hot(spark):
    base = 0x0123456789ABCDEF
    sims = [base ^ i for i in range(4096)]  # all differ in the lowest twelve bits only
    df = spark.createDataFrame([(s,) for s in sims], "sim long")
    for hot in (1000,):
        keys = N.band_keys(df, hot=hot)
        assert max(r["count"] for r in keys.groupBy("band").count().collect()) <= hot
    rng = random.Random(1)
    few = rng.sample(sims, 250)
    want = sum((a ^ b).bit_count() <= 3 for i, a in enumerate(few) for b in few[:i])
    firsts = spark.createDataFrame([(s, i) for i, s in enumerate(few)], "sim long, at long")
    assert N.near_pairs(firsts, hot=20).count() == want


def test_known_hashes_never_meet_each_other(spark, tmp_path):
    rng = random.Random(6)
    old = [rng.getrandbits(63) for _ in range(500)]
    new = [old[3] ^ 0b111, old[4] ^ 0b1111, old[5], *(rng.getrandbits(63) for _ in range(3))]
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "sim long")
    want = sorted(s for s in new if any((s ^ o).bit_count() <= 3 for o in old))
    path = str(tmp_path / "bands")
    N.write_bands(frame(old), path)
    index = spark.read.parquet(path)
    touched = N.touched_bands(index, frame(new))
    assert sorted(r.sim for r in N.near_known(frame(new), touched).collect()) == want
    assert sorted(r.sim for r in N.near_known(frame(new), touched, hot=2).collect()) == want
    # a batch reads the folders that its hashes touch, four each at most
    files = lambda hashes: N.touched_bands(index, frame(hashes)).inputFiles()
    plan = N.touched_bands(index, frame(new[:1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and len({f.split("prefix=")[1].split("/")[0] for f in files(new)}) <= 4 * N.PREFIXES
    assert index.where("prefix IN (1, 70)").count() < index.count() / 20
