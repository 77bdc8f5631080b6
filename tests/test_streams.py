"""Streams over several files end with the batch result."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import palimpsest.catalog.all  # noqa: F401
from palimpsest.catalog import QUERIES
from palimpsest.functions import hashing as H
from palimpsest.operators import chunks as C
from palimpsest.operators import graph as G
from palimpsest.operators import neardup as N
from palimpsest.plans import adapters as A
from palimpsest.plans.kg_build import kg_build
from palimpsest.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The log in five files by time, and a last row that moves the watermark past everything."""
    root = str(tmp_path_factory.mktemp("log"))
    m = A.messages(spark, SF).withColumn("part", F.ntile(5).over(Window.orderBy("ts", "id")))
    for p in range(1, 6):
        m.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(root)
    end = m.drop("part").limit(1).select(F.lit(10**9).alias("id").cast("long"), F.lit("end").alias("session_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit("user").alias("role"),
                                         F.lit("bye.").alias("content"), F.lit(False).alias("is_summary"), "tool_call_id", "tool_calls_json")
    end.coalesce(1).write.mode("append").parquet(root)
    return root


def test_chunks(spark, parts):
    schema = spark.read.parquet(parts).schema
    log = J.stream_table(spark, parts, schema, per_trigger=1)
    out = J.run_available(J.stream_chunks(log), J.work_dir(spark, "t"))
    got = J.latest_chunks(spark.read.parquet(out)).where("session_id <> 'end'").select("session_id", "chunk_ord", "chars", "raw_text")
    want = C.slide_chunks(C.timed_sentences(A.messages(spark, SF))).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_chunks_after_a_pause(spark, tmp_path):
    """A session rests longer than the idle time, twice; its chunks are those of the whole log."""
    rows = [(i, "s", f"2024-01-01 0{h}:0{m}:00", "user", f"Sentence {i} of part {h}. And one more {'x' * (i * 7 % 40)}.", False) for i, (h, m) in enumerate((h, m) for h in (1, 4, 8) for m in range(4))]
    # another session's rows move the watermark while this one rests
    rows += [(100 + h, "clock", f"2024-01-01 0{h}:30:00", "user", "tick.", False) for h in (2, 3, 5, 6)] + [(999, "clock", "2030-01-01 00:00:00", "user", "end.", False)]
    log = spark.createDataFrame(rows, "id long, session_id string, ts string, role string, content string, is_summary boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    for hour in (1, 2, 3, 4, 5, 6, 8, 0):
        log.where(F.hour("ts") == hour).coalesce(1).write.mode("append").parquet(src)
    shown = spark.read.parquet(J.run_available(J.stream_chunks(J.stream_table(spark, src, log.schema, per_trigger=1), 120, 30), J.work_dir(spark, "t"))).where("session_id = 's'")
    got = J.latest_chunks(shown)
    want = C.slide_chunks(C.timed_sentences(log.where("session_id = 's'")), 120, 30).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert shown.count() > got.count()  # an open tail was shown before it grew


def test_repeats_long_after_the_watermark(spark, tmp_path):
    rows = A.messages(spark, SF).limit(20)
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 HOURS")).coalesce(1).write.mode("append").parquet(src)
    out = J.run_available(J.stream_dedupe(J.stream_table(spark, src, rows.schema, per_trigger=1)), J.work_dir(spark, "t"))
    assert spark.read.parquet(out).count() == rows.select("session_id", "role", "content").distinct().count()


def test_turns_and_groups(spark, parts):
    schema = spark.read.parquet(parts).schema
    read = lambda: J.stream_table(spark, parts, schema, per_trigger=1)
    out = spark.read.parquet(J.run_available(J.stream_turn_trigger(read(), 2), J.work_dir(spark, "t")))
    from palimpsest.operators.history import turn_trigger

    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in turn_trigger(A.messages(spark, SF), 2).collect())
    groups = spark.read.parquet(J.run_available(J.stream_groups(read()), J.work_dir(spark, "t")))
    assert groups.where("session_id <> 'end'").agg(F.sum("n")).first()[0] == A.messages(spark, SF).count()


def test_near_dup_over_batches(spark, tmp_path):
    docs = A.table(spark, SF, "documents").select(F.col("doc_id").alias("id"), H.simhash64("text").alias("sim"))
    src = str(tmp_path / "in")
    for p in range(4):
        docs.where(F.floor(F.col("id") / 50) == p).coalesce(1).write.mode("append").parquet(src)
    store = str(tmp_path / "store")
    J.run_batches(J.stream_table(spark, src, docs.schema, per_trigger=1), J.near_dup_writer(store), str(tmp_path / "marks"))
    got = spark.read.parquet(store)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in N.dedupe_near(docs, ["id"]).collect())


def test_restart_goes_on_from_the_mark(spark, tmp_path):
    rows = A.messages(spark, SF)
    src, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    rows.where("id % 2 = 0").coalesce(1).write.parquet(src)
    run = lambda: J.run_available(J.stream_messages(J.stream_table(spark, src, rows.schema)), out, checkpoint=marks)
    run()
    rows.where("id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == J.stream_messages(rows).count()


def test_kg_over_epochs_equals_whole_tables(spark, tmp_path):
    orders = A.table(spark, SF, "orders").where("o_orderkey % 40 = 1")
    dets = A.detections_of(orders, A.table(spark, SF, "customer")).cache()
    aliases = A.aliases(spark, SF).select(*G.ALIAS_COLUMNS).cache()
    store = str(tmp_path / "kg")
    write = J.kg_writer(lambda s: aliases, store)
    known, want = aliases, {"nodes": set(), "aliases": set(), "evidence": set(), "edges": set()}
    for epoch in range(4):
        batch = dets.where(F.pmod(F.xxhash64("msg_id"), F.lit(4)) == epoch)
        write(batch, epoch)
        out = kg_build(batch, known)
        for name in want:
            want[name] |= {tuple(sorted(r.asDict().items(), key=str)) for r in out[name].collect()}
        made = out["aliases"].select(*G.ALIAS_COLUMNS)
        known = known.unionByName(spark.createDataFrame(made.collect(), made.schema))
    for name in want:
        got = {tuple(sorted(r.asDict().items(), key=str)) for r in spark.read.parquet(f"{store}/{name}").drop("epoch").collect()}
        assert got == want[name] and (got or name == "edges")


def test_terms_read_the_parts_they_touch(spark, tmp_path):
    aliases = A.aliases(spark, SF).select(*G.ALIAS_COLUMNS)
    path = str(tmp_path / "index")
    G.write_alias_index(aliases, path)
    index = spark.read.parquet(path)
    rows = aliases.collect()
    for term in ("FRANCE ", "az", "Customer#000000012", "no such thing"):
        near = G.touched_aliases(index, spark.createDataFrame([(term,)], "term string"))
        key = term.strip().lower()
        assert {r.id for r in rows if key in r.alias_key} <= {r.id for r in near.collect()}
    one = G.touched_aliases(index, spark.createDataFrame([("az",)], "term string"))
    assert "prefix" in one._jdf.queryExecution().executedPlan().toString()
    terms = spark.createDataFrame([("az",), ("FRANCE ",), ("ory a",)], "term string")
    whole = {(r.term, r.node_id, r.how) for r in G.alias_best(terms, aliases).collect()}
    assert {(r.term, r.node_id, r.how) for r in G.alias_best(terms, G.touched_aliases(index, terms)).collect()} == whole


@pytest.mark.parametrize("name", ["stream_messages", "stream_dedupe", "stream_groups", "stream_turn_trigger", "stream_chunks", "stream_need_summary", "stream_near_dup"])
def test_table_in_one_file_or_many(spark, tmp_path, name):
    """A given table may be a file or a folder of files."""
    talk = [(c, t, ["system", "user", "assistant", "assistant"][t % 4], f"Turn {t} of talk {c}. It has two sentences.") for c in range(6) for t in range(9)]
    texts = [(i, f"document {i % 5} tells of " + " ".join(f"thing{(i % 5) * 31 + k}" for k in range(40)), "en", "s") for i in range(12)]
    tables = {"conversations": spark.createDataFrame(talk, "conv_id long, turn int, role string, text string"), "documents": spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")}
    for t, rows in tables.items():
        rows.repartition(3).write.parquet(str(tmp_path / "many" / f"{t}.parquet"))
        rows.coalesce(1).write.parquet(str(tmp_path / t))
        (tmp_path / "one").mkdir(exist_ok=True)
        (file,) = (tmp_path / t).glob("part-*")
        (tmp_path / "one" / f"{t}.parquet").write_bytes(file.read_bytes())
    got = {kind: sorted(map(str, QUERIES[name](spark, str(tmp_path / kind)).collect())) for kind in ("one", "many")}
    assert got["one"] and got["many"] == got["one"]
