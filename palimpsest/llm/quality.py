"""Quality classifier: a factorisation machine over hashed words and statistics of the text's structure.

The score of a text is ``bias + sum(w x) + 1/2 sum_f ((sum(v_f x))**2 - sum(v_f**2 x**2))``: all pairs of features interact
through ``rank`` factors, in time linear in the features. It is trained by stochastic gradients in one task, on a sample of
labelled rows whose number is a parameter; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import rolling

WORD_BITS = 13
STEPS = 20
RANK = 8
SAMPLE = 6000
EPOCHS = 6
BATCH = 32
RATE = 0.05
DECAY = 1e-5

#: Kinds of byte, whose shares of a text are statistics.
KINDS = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "space": [0x20, 0x09, 0x0B, 0x0C, 0x0D],
    "line": [0x0A],
    "stop": [*b".,;:"],
    "mark": [*b"!?"],
    "symbol": [*b"#$%&*+/<=>@\\^_`{|}~"],
    "wide": [*range(0x80, 0x100)],
}
STATS = [*KINDS, "distinct words", "word length", "lone words", "repeated bigrams", "word after itself", "length"]
WIDTH = (1 << WORD_BITS) + len(STATS) * (STEPS + 1)


def _sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how many of them occur once."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(v)))
    return np.bincount(r[at], minlength=n), np.bincount(r[at][times == 1], minlength=n)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds, index, value) of the sparse features of runs of texts."""
    for row, data, offsets in rolling.pieces(texts):
        n = len(offsets) - 1
        size = np.maximum(np.diff(offsets), 1)
        stats = [_sum(np.isin(data, np.array(k, np.uint8)), offsets) / size for k in KINDS.values()]
        low = rolling.LOWER[data]
        starts, ends, rows = rolling.spans(low, offsets)
        words = rolling.hashes(rolling.prefix(low), starts, ends)
        count = np.bincount(rows, minlength=n)
        some = np.maximum(count, 1)
        distinct, once = _distinct(words, rows, n)
        pairs, of = rolling.shingles(words, rows, 2, n)
        stats += [distinct / some, np.minimum(np.bincount(rows, ends - starts, n) / some / 20, 1), once / some]
        stats += [1 - _distinct(pairs, of, n)[0] / np.maximum(np.bincount(of, minlength=n), 1)]
        twice = rows[1:][(words[1:] == words[:-1]) & (rows[1:] == rows[:-1])]
        stats += [np.bincount(twice, minlength=n) / some, np.minimum(np.log2(np.diff(offsets) + 1) / 20, 1)]
        # each statistic is one of STEPS + 1 indicators; small shares are told apart by their square root
        steps = np.stack([np.sqrt(s) * STEPS for s in stats], 1).astype(np.int64) + np.arange(len(STATS)) * (STEPS + 1) + (1 << WORD_BITS)
        key, times = np.unique(rows.astype(np.int64) << WORD_BITS | (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        of, weight = key >> WORD_BITS, 1 + np.log(times)
        norm = np.sqrt(np.bincount(of, weight**2, n))
        index = np.concatenate([key & ((1 << WORD_BITS) - 1), steps.ravel()])
        value = np.concatenate([weight / norm[of], np.full(steps.size, len(STATS) ** -0.5)])
        of = np.concatenate([of, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(of, kind="stable")
        yield row, np.searchsorted(of[order], np.arange(n + 1)), index[order], value[order].astype(np.float32)


def _margin(model: np.ndarray, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins, and sums of factor * value, by text; every text has features. Column 0 of the model is linear, the rest factors."""
    part = model[index] * value[:, None]
    sums = np.add.reduceat(part, bounds[:-1], axis=0)
    squares = np.add.reduceat(part[:, 1:] ** 2, bounds[:-1], axis=0)
    return sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1), sums, part


def fit(texts: pa.Array, labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray]:
    """Bias and model (a row per feature), by adaptive gradients of the logistic loss; without rows all is zero."""
    random = np.random.default_rng(seed)
    model = random.normal(0, 0.05, (WIDTH, rank + 1)).astype(np.float32)
    model[:, 0] = 0
    if not len(labels):
        return 0.0, np.zeros_like(model)
    rows = [(i[a:b], v[a:b]) for _, bounds, i, v in features(texts) for a, b in zip(bounds[:-1], bounds[1:])]
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, squares, bias_square = float(np.log(share / (1 - share))), np.full_like(model, 1e-4), 1e-4
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            index, value = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            bounds = np.cumsum([0] + [len(p[0]) for p in part])
            margin, sums, product = _margin(model, bounds, index, value)
            slope = (1 / (1 + np.exp(-(margin + bias))) - labels[order[at : at + BATCH]]).astype(np.float32) / len(part)
            of = np.repeat(np.arange(len(part)), np.diff(bounds))
            grad = sums[of] - product
            grad[:, 0] = 1
            grad *= (slope[of] * value)[:, None]
            touched, place = np.unique(index, return_inverse=True)
            total = np.zeros((len(touched), rank + 1), np.float32)
            np.add.at(total, place, grad)
            total += DECAY * model[touched]
            squares[touched] += total**2
            model[touched] -= RATE * total / np.sqrt(squares[touched])
            bias_square += float(slope.sum()) ** 2
            bias -= RATE * float(slope.sum()) / bias_square**0.5
    return bias, model


def score(texts: pa.Array, bias: float, model: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every text."""
    out = np.empty(len(texts))
    for row, bounds, index, value in features(texts):
        out[row : row + len(bounds) - 1] = 1 / (1 + np.exp(-(_margin(model, bounds, index, value)[0].astype(float) + bias)))
    return out


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 3, is 1; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # few rows, so they may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        data = pa.Table.from_batches(table).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks() if table else None
        texts = data["text"].cast(pa.large_string()).combine_chunks() if table else pa.array([], pa.large_string())
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        bias, model = fit(texts, data["quality"].to_numpy() if table else np.empty(0))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([model.tobytes()], pa.binary())], names=["bias", "model"])

    got = rows.repartition(1).mapInArrow(run, "bias double, model binary").first()
    if got is None:  # no labelled row, no task
        return 0.0, np.zeros((WIDTH, RANK + 1), np.float32)
    return got["bias"], np.frombuffer(got["model"], np.float32).reshape(WIDTH, -1)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` and score, predicted (1 if score >= 0.5), under the given ``names``.

    Only the text enters the score: its words, its structure and its length. A null text is an empty one. Labels: null ones
    are ignored, of several for one id the largest counts; without any every score is 0.5. Every row is scored by itself,
    so repeated rows and rows with a null id have scores too. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    bias, model = train(docs, labels, sample)
    shared = spark.sparkContext.broadcast(model)  # WIDTH * (RANK + 1) numbers, whatever the input
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score_ = score(batch.column(batch.schema.get_field_index("text")), bias, shared.value)
            yield batch.append_column(names[0], pa.array(score_))

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType())]))
    return out.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))
