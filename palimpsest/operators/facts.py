"""Fact memory: rows (owner, key, fact, pos); a set of facts per key, in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.text import bound
from palimpsest.operators.ordered import join_ordered
from palimpsest.session import checkpointed

DEFAULT_KEY = "General"
NO_FACTS = "memories: none"


def natural_key(col) -> Column:
    """Sort key: case-insensitive, digit runs of any length compared as numbers: by how many digits, then by the digits."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), bound(F.regexp_replace(p, r"^0+(?=\d)", ""), lambda n: F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n))).otherwise(p)), "")


def facts_list(facts: DataFrame) -> DataFrame:
    """Non-blank facts, first occurrence of each per (owner, key), with the key's sort form."""
    rows = facts.where(F.trim("fact") != "").groupBy("owner", "key", "fact").agg(F.min("pos").alias("pos"))
    return rows.withColumn("key_order", natural_key("key"))


def facts_remember(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new facts added at the end unless their key has them."""
    n = new.withColumn("fact", X.trim_ws("fact")).where("fact <> ''").withColumn("key", F.coalesce(F.nullif("key", F.lit("")), F.lit(DEFAULT_KEY)))
    both = store.select("owner", "key", "fact", F.struct(F.lit(0).alias("g"), "pos").alias("o")).unionByName(n.select("owner", "key", "fact", F.struct(F.lit(1).alias("g"), "pos").alias("o")))
    out = both.groupBy("owner", "key", "fact").agg(F.min("o").alias("o"))
    return out.select("owner", "key", "fact", F.col("o.pos").alias("pos"), (F.col("o.g") == 1).alias("added"))


def facts_forget(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the named facts; key ``*`` takes a fact from every key."""
    every = gone.where("key = '*'").select("owner", "fact").distinct()
    one = gone.where("key <> '*'").select("owner", "key", "fact").distinct()
    return store.join(every, ["owner", "fact"], "left_anti").join(one, ["owner", "key", "fact"], "left_anti").select(*store.columns)


def facts_render(facts: DataFrame, owners: DataFrame | None = None, empty: str = NO_FACTS) -> DataFrame:
    """``memories: keys=a,b | a[f1; f2] | b[f3]`` per owner."""
    rows = facts_list(facts)
    per_key = rows.groupBy("owner", "key", "key_order").agg(join_ordered("fact", ["pos"], "; ").alias("body"))
    chunk = F.concat("key", F.lit("["), "body", F.lit("]"))
    out = per_key.groupBy("owner").agg(join_ordered("key", ["key_order", "key"], ",").alias("keys"), join_ordered(chunk, ["key_order", "key"], " | ").alias("parts"))
    out = out.select("owner", F.concat(F.lit("memories: keys="), "keys", F.lit(" | "), "parts").alias("line"))
    if owners is None:
        return out
    return owners.select("owner").distinct().join(out, "owner", "left").withColumn("line", F.coalesce("line", F.lit(empty)))


def facts_render_legacy(entries: DataFrame) -> DataFrame:
    """``memories: f1 | f2`` from flat entries."""
    rows = entries.where(F.trim("fact") != "")
    return rows.groupBy("owner").agg(F.concat(F.lit("memories: "), join_ordered("fact", ["pos"], " | ")).alias("line"))


def facts_apply(store: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, results) after memory blocks (owner, at, op, key, fact) in order of ``at``.

    A fact is there if it was written after the last delete that touches it, and its place is the first such
    write; so the last delete per fact and the writes after it decide, without replaying the sequence.
    """
    o = ops.select(
        "owner", "at", F.lower(F.coalesce("op", F.lit(""))).alias("op"), X.trim_ws(F.coalesce("fact", F.lit(""))).alias("fact"),
        F.coalesce(F.nullif(X.trim_ws(F.coalesce("key", F.lit(DEFAULT_KEY))), F.lit("")), F.lit(DEFAULT_KEY)).alias("key"),
    )
    o = checkpointed(o)  # parsed once, read by writes, deletes and results
    good = o.where("fact <> '' AND op IN ('upsert', 'delete')")
    status = F.when((F.col("fact") == "") | ~F.col("op").isin("upsert", "delete"), "bad_request").when(F.col("op") == "upsert", "remembered").otherwise("forgot")
    results = o.withColumn("status", status)
    old = store.select("owner", "key", "fact", F.struct(F.lit(0).alias("g"), F.col("pos").alias("n")).alias("o"))
    stamp = F.struct(F.lit(1).alias("g"), F.col("at").alias("n")).alias("o")
    writes = old.unionByName(good.where("op = 'upsert'").select("owner", "key", "fact", stamp))
    dels = good.where("op = 'delete'")
    one = dels.where("key <> '*'").groupBy("owner", "key", "fact").agg(F.max("at").alias("d1"))
    every = dels.where("key = '*'").groupBy("owner", "fact").agg(F.max("at").alias("d2"))
    live = writes.join(one, ["owner", "key", "fact"], "left").join(every, ["owner", "fact"], "left")
    cut = F.greatest("d1", "d2")
    live = live.where(cut.isNull() | ((F.col("o.g") == 1) & (F.col("o.n") > cut)))
    out = live.groupBy("owner", "key", "fact").agg(F.min("o").alias("o"))
    return out.select("owner", "key", "fact", F.col("o.g").alias("gen"), F.col("o.n").alias("pos")), results
