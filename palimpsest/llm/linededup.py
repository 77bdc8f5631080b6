"""Line dedup by a segment-partition edit join.

Two lines within ``threshold`` edits share one of ``threshold + 1`` segments of the shorter one, at a place shifted by no
more than the edits allow. Every line is indexed under (length, segment, hash of the segment) and probes the indexes of its
own and of ``threshold`` smaller lengths with those substrings that a match could need. Lines under one key are compared
through hubs, by banded bit-parallel edit distance. Equal lines are one node from the start. Lengths, segments and edits are
counted in code points, or in UTF-8 bytes if so asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import rolling, stars
from palimpsest.llm.shared import ascii_lower, let, unused, written

THRESHOLD = 2
LEAST_WORDS = 5
LEAST_BYTES = 40
#: The whole job, for queries and stages: every line that is not blank counts as the copy of an equal one, and near matches
#: need five words or 20 characters, as scripts without spaces have one word a line. Edits are of characters.
WHOLE = {"least_words": 1, "least_bytes": 0, "near_words": 5, "near_chars": 20, "chars": True}

_BREAK = np.zeros(256, bool)
_BREAK[0x0A] = True


def _lines(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first row, bytes' prefix sums, starts, ends, rows, numbers and word counts of lines that are not empty, and the number of
    characters that start before each byte."""
    for row, data, offsets in rolling.pieces(texts):
        low = rolling.LOWER[data]
        starts, ends, rows = rolling.spans(low, offsets, _BREAK)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[low])])
        number = breaks[starts] - breaks[offsets[rows]]
        word_starts, _, _ = rolling.spans(low, offsets)
        words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        yield row, rolling.prefix(low), starts, ends, rows, number, words, points


def segments(length: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (lines x segments) of an even partition; the last segments are one longer."""
    parts = threshold + 1
    size = length[:, None] // parts + (np.arange(parts) >= parts - length[:, None] % parts)
    return np.cumsum(size, axis=1) - size, size


def _keys(sums: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int, index: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of every segment, or of every substring that the segment of a line no longer may match, its own included.

    Starts and ends count units (characters or bytes); ``places`` has the byte at which each begins, and the end."""
    length = ends - starts
    for less in range(1 if index else threshold + 1):
        at, size = segments(length - less, threshold)
        for i in range(threshold + 1):
            rest = threshold - i
            salt = rolling.mix((length - less).astype(np.uint64) * np.uint64(threshold + 1) + np.uint64(i + 1))
            for shift in range(1) if index else range(max(-i, less - rest), min(i, less + rest) + 1):
                p, n = at[:, i] + shift, size[:, i]
                ok = np.flatnonzero((p >= 0) & (p + n <= length) & (n > 0))
                found = rolling.hashes(sums, places[starts[ok] + p[ok]], places[starts[ok] + p[ok] + n[ok]])
                yield ok, rolling.mix(found ^ salt[ok])


def line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, text_key, number, line) of all lines with enough words; ``line`` is the hash of its folded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sums, starts, ends, rows, number, words, _ in _lines(batch.column("text")):
                keep = words >= least_words
                starts, ends, at = starts[keep], ends[keep], pa.array(rows[keep] + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        batch.column("text_key").take(at),
                        pa.array(number[keep].astype(np.int32)),
                        pa.array(rolling.hashes(sums, starts, ends).view(np.int64)),
                    ],
                    names=["doc_id", "text_key", "number", "line"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, number int, line long")


def segment_keys(docs: DataFrame, threshold: int, near_words: int, near_chars: int | None, least_bytes: int, chars: bool, index: bool) -> DataFrame:
    """(bucket, node) under which lines long enough for near matches are indexed, or all that they probe; equal lines of a run
    of texts come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sums, starts, ends, _, _, words, points in _lines(batch.column("text")):
                enough = words >= near_words
                if near_chars is not None:
                    enough |= (words > 0) & (points[ends] - points[starts] >= near_chars)
                # each segment has a unit at least
                size = points[ends] - points[starts] if chars else ends - starts
                keep = enough & (ends - starts >= least_bytes) & (size > threshold)
                node, first = np.unique(rolling.hashes(sums, starts[keep], ends[keep]), return_index=True)
                starts, ends = starts[keep][first], ends[keep][first]
                places = np.arange(len(points))
                if chars:
                    places, starts, ends = np.append(np.flatnonzero(np.diff(points)), len(points) - 1), points[starts], points[ends]
                for at, key in _keys(sums, places, starts, ends, threshold, index):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[at].view(np.int64))], names=["bucket", "node"])

    return docs.select("text").mapInArrow(run, "bucket long, node long")


def _units(line: bytes, chars: bool) -> np.ndarray:
    """The code points of a line, or its bytes."""
    if chars and not line.isascii():
        return np.frombuffer(line.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.frombuffer(line, np.uint8)


def within(a: list[bytes], b: list[bytes], threshold: int, chars: bool = False) -> np.ndarray:
    """Which pairs have an edit distance of at most ``threshold`` (below 31), in bytes or in characters.

    All pairs advance together, a column at a time: the differences down the 2 * threshold + 1 cells around the diagonal are
    bits of one word a pair (Hyyrö's banded form of Myers' algorithm). Common beginnings and ends are cut off before.
    """
    cut = []
    for x, y in zip(a, b):
        x, y = _units(x, chars), _units(y, chars)
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        start = int(differ[0]) if len(differ) else n
        x, y = x[start:], y[start:]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
        end = n - 1 - int(differ[-1]) if len(differ) else n
        x, y = x[: len(x) - end], y[: len(y) - end]
        cut.append((x, y) if len(x) >= len(y) else (y, x))
    m, n = (np.array([len(c[k]) for c in cut], np.int64) for k in (0, 1))
    out = np.zeros(len(cut), bool)
    out[(n == 0) & (m <= threshold)] = True
    live = np.flatnonzero((n > 0) & (m - n <= threshold))
    for block in np.array_split(live[np.argsort(m[live])], max(1, len(live) // 512)):
        if len(block):
            out[block] = _banded([cut[i] for i in block.tolist()], m[block], n[block], threshold)
    return out


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """``within`` for pairs whose first is no shorter (lengths m >= n > 0) and no more than t longer."""
    one, band = np.uint64(1), 2 * t + 1
    width = int(m.max()) + 2 * band
    x = np.full((len(pairs), width), -1, np.int32)  # the longer text, shifted by the band; the shorter one
    y = np.full((len(pairs), int(n.max())), -2, np.int32)
    for i, (p, q) in enumerate(pairs):
        x[i, band : band + len(p)] = p
        y[i, : len(q)] = q
    bits = (one << np.arange(band, dtype=np.uint64))[None, :]
    full, bottom = np.uint64((1 << band) - 1), np.uint64(1 << (2 * t))
    # bit k of column j stands for row j - t + k; rows down from row 0 rise by one in column 0
    vp = np.full(len(pairs), np.uint64(((1 << (t + 1)) - 1) << t))
    vn = np.zeros(len(pairs), np.uint64)
    distance = np.full(len(pairs), t, np.int64)  # at row j + t, then at row m
    for j in range(1, int(n.max()) + 1):
        match = ((x[:, band + j - 1 - t : band + j + t] == y[:, j - 1 : j]) * bits).sum(axis=1, dtype=np.uint64)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        row = m - (j - t)  # the bit of row m
        down = row >= 2 * t
        at = one << np.clip(row, 0, 2 * t).astype(np.uint64)
        step = np.where(down, ((d0 & bottom) == 0).astype(np.int64), ((hp & at) != 0).astype(np.int64) - ((hn & at) != 0))
        distance += np.where(j <= n, step, 0)
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
    return distance <= t


def similar_lines(left: list[bytes], right: list[bytes] | None, threshold: int, chars: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of two lists of lines, or within one, that ``within`` finds near.

    An edit changes at most two counts of units by one each; pairs whose counts differ by more are not compared.
    """
    lines = left + (right or [])
    counts = np.array([np.bincount(_units(x, chars) & 0x3F, minlength=64) for x in lines], np.int32)
    a = counts[: len(left)]
    b = counts if right is None else counts[len(left) :]
    i, j = np.nonzero(np.stack([np.abs(row - b).sum(axis=1) <= 2 * threshold for row in a]))
    if right is None:
        i, j = i[i < j], j[i < j]
    near = within([left[k] for k in i.tolist()], [(left if right is None else right)[k] for k in j.tolist()], threshold, chars)
    return i[near], j[near]


def _near(pairs: DataFrame, threshold: int, chars: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = within(batch.column("bytes_a").to_pylist(), batch.column("bytes_b").to_pylist(), threshold, chars)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long")


def _folded(lines: Column) -> Column:
    return ascii_lower(lines).cast("binary")


def repeated_lines(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    least_words: int = LEAST_WORDS,
    least_bytes: int = LEAST_BYTES,
    near_words: int | None = None,
    near_chars: int | None = None,
    chars: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_lines, numbers): the lines to drop of each document that has some; and (line, root) of near classes.

    Of each class of equal or near lines the first stays, in the order of doc_id (null first), text_key and number.
    """
    near_words = least_words if near_words is None else near_words
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    lines = written(line_table(docs, least_words), "lines")
    # made twice rather than written: there are a dozen for each line
    index, probe = (segment_keys(docs, threshold, near_words, near_chars, least_bytes, chars, which) for which in (True, False))
    members = stars.shared(index, probe)

    # the lines that share a key: read from the place where each occurs first
    place = (
        lines.join(members.select(F.col("node").alias("line")).distinct(), "line")
        .groupBy("line")
        .agg(F.min(F.struct("doc_id", "text_key", "number")).alias("at"))
        .select("line", "at.*")
    )
    wanted = place.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_key"] == wanted["text_key"])
    split = docs.join(wanted, same).select(F.split("text", "\n").alias("all"), "wanted")
    texts = split.select(F.explode(F.transform("wanted", lambda w: F.struct(w["line"].alias("node"), F.get(F.col("all"), w["number"]).alias("text")))).alias("r"))
    texts = written(texts.select("r.node", _folded(F.col("r.text")).alias("bytes")).dropDuplicates(["node"]), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("node").alias(x), F.col("bytes").alias(f"bytes_{x}")) for x in "ab")
        return _near(pairs.join(left, "a").join(right, "b"), threshold, chars)

    roots, _ = stars.linked(members, verify, texts.withColumnRenamed("bytes", "payload"), lambda x, y: similar_lines(x, y, threshold, chars))
    roots = roots.withColumnRenamed("node", "line")
    classed = lines.join(roots, "line", "left").select("doc_id", "text_key", "number", F.coalesce("root", "line").alias("class"))
    first = classed.groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    drop = classed.join(first, "class").where(~F.struct("doc_id", "text_key", "number").eqNullSafe(F.col("first")))
    drop = drop.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return drop, roots


def line_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, dropped (numbers from 0, comma-joined).

    Lines end at line feeds; a null text has none, an empty one has one empty line. A line of fewer than ``least_words`` words
    (runs between ASCII white space) is never dropped; one shorter than ``least_bytes``, or with fewer than ``near_words`` words
    (by default ``least_words``) and, if given, fewer than ``near_chars`` characters, only as the copy of an equal line. Edits are
    of bytes, or with ``chars`` of characters. ``WHOLE`` has the options under which every line that is not blank takes part. A-Z and a-z are the same. Rows equal in
    id and text count as one document: all keep the first occurrence. Rows with a null id come first. ``docs`` needs
    doc_id and text; other columns are ignored. Every row gives a row; no rows give none.
    """
    drop, _ = repeated_lines(docs, **options)
    drop = drop.withColumnsRenamed({"doc_id": "drop_id", "text_key": "drop_key"})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = lines.join(drop, lines["doc_id"].eqNullSafe(drop["drop_id"]) & (lines["text_key"] == drop["drop_key"]), "left")
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_dropped"), F.array_join(numbers, ",").alias("dropped"))


def dedupe_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without repeated lines; a document that loses every line with a word goes. Columns may have any names."""
    drop, _ = repeated_lines(docs, **options)
    id_, key, gone = (unused(docs, n) for n in ("drop_id", "drop_key", "drop_numbers"))
    drop = drop.withColumnsRenamed({"doc_id": id_, "text_key": key, "numbers": gone})
    lines = F.split("text", "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.when(F.size(rest) > 0, let(lines, lambda all_: F.array_join(F.transform(rest, lambda i: F.get(all_, i)), "\n"))).otherwise("")
    names = docs.columns
    same = docs["doc_id"].cast("long").eqNullSafe(drop[id_]) & (F.xxhash64(docs["text"]) == drop[key])
    out = docs.join(drop, same, "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    return out.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{n}`") for n in names])
