"""Benchmark decontamination by winnowing, in column expressions only.

Every document and every benchmark item keeps the smallest hash of each run of ``WINDOW - GRAM + 1`` consecutive word
grams. Two texts that share ``WINDOW`` words in a row share such a run, so they share its smallest hash: joining the kept
hashes misses no shared window. Each hit is extended to the windows around it, and these are compared as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import ascii_lower, let, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram_hashes(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, by position; empty for shorter texts."""
    return F.when(
        F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    ).otherwise(F.array().cast("array<bigint>"))


def winnowed(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Distinct smallest gram hashes over all runs of ``window - gram + 1`` grams."""
    run = window - gram + 1
    return let(
        _gram_hashes(words, gram),
        lambda h: F.when(
            F.size(h) >= run, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (run - 1)), lambda i: F.array_min(F.slice(h, i, F.lit(run)))))
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _fingerprints(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Winnowed hashes, and all grams of the lengths that items shorter than a window have."""
    return F.array_distinct(F.concat(winnowed(words, window, gram), *[_gram_hashes(words, n) for n in short]))


def _windows(words: Column, window: int) -> Column:
    """All windows of an item as strings: its runs of ``window`` words, or the whole of a shorter one."""
    return F.when(
        F.size(words) >= window,
        F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(window)), " ")),
    ).otherwise(F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def _candidates(words: Column, hits: Column, window: int, gram: int, short: list[int]) -> Column:
    """Start, length and words of every window around a hit."""

    def around(h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(hits, F.element_at(h, i)))
        low = F.lit(gram - window)
        starts = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(1), i + low), F.least(i, F.size(words) - (window - 1)))))
        return F.when((F.size(h) >= window - gram + 1), F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))

    def rows(starts: Column, size: int) -> Column:
        return F.transform(
            starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("length"), F.array_join(F.slice(words, s, F.lit(size)), " ").alias("window"))
        )

    parts = [rows(let(_gram_hashes(words, gram), around), window)]
    for n in short:
        parts.append(
            rows(
                let(_gram_hashes(words, n), lambda h: F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(hits, F.element_at(h, i)))).otherwise(F.array().cast("array<int>"))),
                n,
            )
        )
    return F.when(F.size(hits) > 0, F.concat(*parts))


def _covered(spans: Column) -> Column:
    """Number of words inside any (start, length) span."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: words, words inside a benchmark window, items with such windows, digest of their ids, contaminated.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A null or empty text has no
    words and no hits; an item without words has no window. Rows equal in id and text count once; rows with one id and
    different texts are documents of their own. Items that share an id count once in ``n_items``; a null item id is
    joined as the text ``null``. Empty tables give no rows, or rows without hits. ``spans`` are the covered windows
    (start from 0, length) in order.
    """
    docs = docs.select("doc_id", "text")
    items = written(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0),
        "items",
    )
    # lengths below one window: fewer than ``window`` rows
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    grams = written(items.select(F.explode(_fingerprints(F.col("words"), window, gram, short)).alias("hash")).distinct(), "item-hashes")
    windows = (
        items.select("item_id", F.explode(_windows(F.col("words"), window)).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("items_key", F.md5(F.array_join("items", ",")))
    )
    windows = written(windows, "item-windows")

    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    hits = (
        keyed.select("doc_id", "text_key", F.explode(let(words_of(F.col("text")), lambda w: _fingerprints(w, window, gram, short))).alias("hash"))
        .join(grams, "hash")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("hash").alias("hits"))
        .withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    )
    same = keyed["doc_id"].eqNullSafe(hits["hit_id"]) & (keyed["text_key"] == hits["hit_key"])
    found = keyed.join(hits, same, "left").select("doc_id", "text_key", "text", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"))
    found = found.select(
        "doc_id",
        "text_key",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _candidates(w, F.col("hits"), window, gram, short).alias("at"))).alias("w"),
    )
    found = found.select("doc_id", "text_key", "w.n_words", F.explode_outer("w.at").alias("at")).select("doc_id", "text_key", "n_words", "at.*")
    found = found.join(windows.select("window", "items_key"), "window", "left")
    span = F.struct((F.col("start") - 1).alias("start"), "length")
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("items_key").isNotNull(), span))).alias("spans"),
        F.collect_set("items_key").alias("keys"),
    )
    # windows of one passage belong to one set of items: a document looks each set up once
    sets = windows.select("items_key", "items").distinct()
    rows = per_doc.select("doc_id", "text_key", "n_words", "spans", _covered(F.col("spans")).alias("n_hit"), F.explode_outer("keys").alias("items_key"))
    rows = rows.join(sets, "items_key", "left").select("doc_id", "text_key", "n_words", "spans", "n_hit", F.explode_outer("items").alias("item_id"))
    out = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.first("spans").alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns, without a benchmark window; rows keep their number."""
    hit = contamination(docs, benchmark, window, gram).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_key"]), "left_anti")
