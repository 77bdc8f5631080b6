"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are added as log odds: the text's byte n-grams, the language that the markup declares, the last part
of the address, and the host. What a declaration or a suffix says is learnt from the pages themselves, by grouped sums of
the posteriors that the text alone gives; a host's prior is smoothed by its domain's and that by all pages'. A page's own
share is taken out of every sum that judges it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import rolling
from palimpsest.llm.shared import written

GRAM = 4
BITS = 15
SAMPLE = 8000
TEMPER = 0.05  # neighbouring n-grams are not independent
MOST_NATS = 60.0  # text evidence of two languages differs by no more
SMOOTH = 5.0


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, text, texts) of all byte n-grams within texts, white space runs and digits folded."""
    for _, data, offsets in rolling.pieces(texts):
        data = rolling.LOWER[data].copy()
        data[rolling.SPACE[data] | ((data >= 0x30) & (data <= 0x39))] = 0x20
        if len(data) < GRAM:
            yield np.empty(0, np.int64), np.empty(0, np.int64), len(offsets) - 1
            continue
        key = np.zeros(len(data) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            key = key << np.uint64(8) | data[k : len(data) - GRAM + 1 + k]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = rows[: len(key)] == rows[GRAM - 1 :]
        yield (rolling.mix(key[inside]) >> np.uint64(64 - BITS)).astype(np.int64), rows[: len(key)][inside], len(offsets) - 1


def text_model(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language x bucket), from at most ``sample`` labelled texts chosen by a hash of the id."""
    ids = labelled.where("lang is not null and text is not null").select("doc_id", "lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang").limit(sample)
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            done = 0
            for key, row, n in _grams(batch.column("text")):
                of = lang[done : done + n][row]
                done += n
                for name in set(of):
                    counts[name] = counts.get(name, 0) + np.bincount(key[of == name], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.astype("<i8").tobytes() for c in counts.values()], pa.binary())], names=["lang", "counts"])

    rows = sorted((r["lang"], np.frombuffer(r["counts"], "<i8")) for r in texts.repartition(1).mapInArrow(run, "lang string, counts binary").collect())
    counts = np.array([c for _, c in rows], float).reshape(len(rows), 1 << BITS) + 0.5
    return [name for name, _ in rows], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, tags and entities."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w{1,10};", " ")


def _evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``pages`` with ``odds``, the text's tempered log likelihoods, the largest being 0, in place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, len(langs)))]
            for key, row, n in _grams(batch.column("text")):
                found.append(np.stack([np.bincount(row, m[key], n) for m in model], 1))
            odds = TEMPER * np.concatenate(found)
            odds = np.maximum(odds - odds.max(axis=1, keepdims=True), -MOST_NATS)
            yield batch.drop_columns(["text"]).append_column("odds", pa.array(list(odds), pa.list_(pa.float64())))

    return pages.mapInArrow(run, "page_id long, declared string, suffix string, host string, domain string, odds array<double>")


def _softmax(odds: Column) -> Column:
    top = F.array_max(odds)
    raised = F.transform(odds, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(pages: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors by group, as an array."""
    return pages.groupBy(*by).agg(F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(n)]).alias(name))


def identify(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, lang, probability, text_lang (by the text alone), declared, host.

    ``pages`` needs page_id, url and html, ``labelled`` doc_id, text and lang; other columns are ignored. Declarations are read
    from the html tag, without their region. A null or empty page has no text evidence, a null address no host and no
    suffix; missing evidence counts for nothing, and missing values form groups of their own. Without labelled texts lang is
    null. Ties go to the first language by name. Repeated rows count and return again; no rows give none.
    """
    langs, model = text_model(labelled, sample)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        declared.alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        page_text(F.col("html")).alias("text"),
    )
    n = len(langs)
    if not n:
        return read.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    judged = written(_evidence(read, langs, model).withColumn("own", _softmax(F.col("odds"))), "text-evidence")
    everything = judged.agg(*[F.sum(F.get("own", F.lit(i))).alias(str(i)) for i in range(n)]).first()
    total = F.lit([float(x or 0.0) for x in everything])

    joined = judged
    for by, name in ((["declared"], "by_declared"), (["suffix"], "by_suffix"), (["domain"], "by_domain"), (["host"], "by_host")):
        joined = joined.join(_sums(judged, by, n, name), by)

    def less(sums: Column, own: Column) -> Column:
        return F.zip_with(sums, own, lambda s, o: F.greatest(s - o, F.lit(0.0)))

    def share(sums: Column, back: Column) -> Column:
        """Shares of languages in a group, smoothed by those of a larger one."""
        size = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(sums, back, lambda s, b: (s + SMOOTH * b) / (size + SMOOTH))

    own = F.col("own")
    joined = joined.withColumn("rest", less(total, own)).withColumn("overall", share(F.col("rest"), F.lit([1.0 / n] * n)))
    joined = joined.withColumn("prior", share(less(F.col("by_host"), own), share(less(F.col("by_domain"), own), F.col("overall"))))
    ratios = []
    for kind in ("declared", "suffix"):
        # log P(value | language), up to what is the same for all: P(language | value) / P(language)
        given = F.zip_with(share(less(F.col(f"by_{kind}"), own), F.col("overall")), F.col("overall"), lambda g, o: F.log(g / o))
        ratios.append(F.when(F.col(kind) != "", given).otherwise(F.lit([0.0] * n)))
    odds = F.zip_with("odds", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b)
    for r in ratios:
        odds = F.zip_with(odds, r, lambda a, b: a + b)
    names = F.lit(langs)

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    out = joined.withColumn("posterior", _softmax(odds))
    return out.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("own")).alias("text_lang"), "declared", "host")
