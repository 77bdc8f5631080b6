"""Phrase collocations from a weighted de Bruijn graph.

Nodes are runs of one word less than the longest phrase, edges are the longest runs: each word of a piece opens one edge, cut
short where the piece ends. Tasks count the edges of their texts before the shuffle. All edges that begin with the same two
words meet in one part, where the count of a node is the flow of its edges plus the pieces that end in it, and so on
down to single words; only what is frequent enough leaves it. Pairs of very common words are dealt over many parts by
their third word. Frequent edges are then compacted along unary paths, and candidates are held against the paths.
"""

from __future__ import annotations

import math
import string
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import rolling
from palimpsest.llm.shared import written
from palimpsest.session import checkpointed

LEAST = 30
COVERED = 80  # per cent of a candidate's occurrences inside a longer one
TOP = 2000
#: Words of a language between two flushes of a task's counts, edges that a part takes in, texts taken at once, languages held.
FLUSH_WORDS = 1_500_000
PART_EDGES = 1_000_000
LOT_CHARS = 1 << 20
LOTS = 64
#: Share of the words from which a word counts as very common: at most so many words are.
COMMON = 128
SALTS = 64
SAMPLE = 0.02

COUNT = "lang string, size int, phrase string, n long, part boolean"
COUNT_NAMES = [f.split()[0] for f in COUNT.split(", ")]

#: No UTF-8 text has this byte: it marks the end of a piece.
_END = 0xFF
_FOLD = bytearray(range(256))
for _a, _b in zip(string.ascii_uppercase, string.ascii_lowercase):
    _FOLD[ord(_a)] = ord(_b)
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = _END
_FOLD = bytes(_FOLD)
_MARK = bytes([_END])


def tokens(texts: list[str | None]) -> list[bytes]:
    """The words of the texts, and a mark at the end of each piece."""
    whole = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n"
    return whole.translate(_FOLD).replace(_MARK, b" \xff ").split()


class _Counts:
    """Words of one language, by numbers, and the edges they make."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[_MARK]
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        words = tokens(texts)
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.found.append(found)
        self.size += len(found)

    def edges(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, the four words of each edge as numbers (0: the piece has ended), and how often it occurs."""
        words = [b"", *list(self.numbers)[1:]]
        self.numbers = None
        at = np.concatenate([*self.found, np.zeros(3, np.int32)])
        self.found = []
        start = np.flatnonzero(at[:-3])
        run = [at[start]]
        for k in range(1, 4):
            run.append(np.where(run[-1] > 0, at[start + k], 0))
        del start, at
        # two words are numbered anew before the edge becomes one number: numbers of words may take 32 bits each
        tails, tail = np.unique(run.pop(2).astype(np.int64) * len(words) + run.pop(2), return_inverse=True)
        heads, head = np.unique(run.pop(0).astype(np.int64) * len(words) + run.pop(0), return_inverse=True)
        head *= len(tails)
        head += tail
        del tail
        edge, n = np.unique(head, return_counts=True)
        head, tail = (heads[edge // len(tails)], tails[edge % len(tails)]) if len(edge) else (edge, edge)
        return words, np.stack([head // len(words), head % len(words), tail // len(words), tail % len(words)]), n


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _block(words: list[bytes], edge: np.ndarray, n: np.ndarray) -> bytes:
    """Edges with the words that they use, as compressed bytes."""
    used, at = np.unique(edge, return_inverse=True)
    columns = [*_narrow(at.reshape(edge.shape).astype(np.uint32)), _narrow(n)]
    listed = b" ".join(words[w] or _MARK for w in used.tolist())
    head = struct.pack("<QQQBB", len(listed), len(used), edge.shape[1], columns[0].itemsize, columns[4].itemsize)
    whole = head + listed + b"".join(c.tobytes() for c in columns)
    return struct.pack("<Q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def _unblock(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    whole = pa.decompress(block[8:], struct.unpack_from("<Q", block)[0], codec="zstd", asbytes=True)
    listed, used, edges, size, wide = struct.unpack_from("<QQQBB", whole)
    at = struct.calcsize("<QQQBB")
    words = whole[at : at + listed].split(b" ") if used else []
    at += listed
    edge = np.frombuffer(whole, f"<u{size}", 4 * edges, at).reshape(4, edges).astype(np.int64)
    return words, edge, np.frombuffer(whole, f"<u{wide}", edges, at + 4 * edges * size).astype(np.int64)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, about a megabyte of them."""
    held, size = defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang, text = lang.as_py(), text.as_py() or ""
            held[lang].append(text)
            size[lang] += len(text)
            if size[lang] >= LOT_CHARS:
                size.pop(lang)
                yield lang, held.pop(lang)
            elif len(held) > LOTS:
                size.popitem()
                yield held.popitem()
    yield from held.items()


def edges(docs: DataFrame, common: frozenset[bytes], parts: int) -> DataFrame:
    """(part, lang, block): edges counted by task, in a block for each part that has some. An edge may be in several blocks of its
    part. The first two words of an edge decide on its part; if both are very common, the third one, too."""

    def blocks(lang: str, counts: _Counts) -> Iterator[pa.RecordBatch]:
        words, edge, n = counts.edges()
        hashed = rolling.mix(np.array([zlib.crc32(w) + 1 for w in words], np.uint64))
        hot = np.array([w in common for w in words], bool)
        salt = np.where(hot[edge[0]] & hot[edge[1]], 1 + hashed[edge[2]] % np.uint64(SALTS), 0).astype(np.uint64)
        start = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
        part = rolling.mix(rolling.mix(rolling.mix(hashed[edge[0]] + start) ^ hashed[edge[1]]) + salt) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            at = np.sort(order[bounds[k] : bounds[k + 1]])
            block = _block(words, edge[:, at], n[at])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lang], pa.string()), pa.array([block], pa.binary())], names=["part", "lang", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = defaultdict(_Counts)
        for lang, texts in _lots(batches):
            held[lang].add(texts)
            if held[lang].size >= FLUSH_WORDS or sum(c.size for c in held.values()) >= 2 * FLUSH_WORDS:
                most = max(held, key=lambda x: held[x].size)
                yield from blocks(most, held.pop(most))
        for lang in list(held):
            yield from blocks(lang, held.pop(lang))

    return docs.mapInArrow(run, "part int, lang string, block binary")


def common_words(docs: DataFrame) -> frozenset[bytes]:
    """Words that hold more than 1/128 of the words of a sample of the documents: at most 128. They only decide how edges are
    dealt out; no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                words, n = np.unique([w for w in tokens(batch.column("text").slice(at, 256).to_pylist()) if w != _MARK] or [b""], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    words = docs.sample(SAMPLE, seed=1).select("text").mapInArrow(run, "word binary, n long").where("word <> X''").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    total = docs.sample(SAMPLE, seed=1).select(F.sum(F.size(F.split("text", " "))).alias("n")).first()["n"] or 0
    return frozenset(bytes(r["word"]) for r in words if r["n"] * COMMON > total)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def flows(blocks: DataFrame, least: int, common: frozenset[bytes]) -> DataFrame:
    """(lang, size, phrase, n, part): counts of phrases that occur often enough, from the edges of one part of a language at a time.

    The count of a node is the flow of its edges, the cut ones of pieces that end in it included; that of its first two words
    is the flow of such nodes. Single words, and pairs that are dealt over several parts, come as parts to be added up.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, edge, n = zip(*(_unblock(b) for b in table["block"].to_pylist()))
        shift = np.cumsum([0, *map(len, words)])
        coded = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode()
        number, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        edge = np.concatenate([number[e + s] for e, s in zip(edge, shift)], axis=1)
        n = np.concatenate(n)
        end = known.index(_MARK) if _MARK in known else -1
        hot = np.array([w in common for w in known], bool)
        order = np.lexsort(edge[::-1])
        edge, n = edge[:, order], n[order]
        texts = pa.array([b"" if w == _MARK else w for w in known], pa.binary()).cast(pa.string())
        out = []
        for size in range(4, 0, -1):
            at = _runs(*edge[:size])
            total = np.add.reduceat(n, at) if len(at) else np.empty(0, np.int64)
            part = np.full(len(at), size == 1)
            if size == 2:
                part = hot[edge[0, at]] & hot[edge[1, at]]
            keep = (edge[size - 1, at] != end) & ((total >= least) | part)
            at, total, part = at[keep], total[keep], part[keep]
            phrase = texts.take(pa.array(edge[0, at]))
            for k in range(1, size):
                phrase = pc.binary_join_element_wise(phrase, texts.take(pa.array(edge[k, at])), " ")
            out.append(pa.table([pa.array([key[1].as_py()] * len(at), pa.string()), pa.array(np.full(len(at), size), pa.int32()), phrase, pa.array(total, pa.int64()), pa.array(part)], names=COUNT_NAMES))
        return pa.concat_tables(out)

    return blocks.groupBy("part", "lang").applyInArrow(run, COUNT)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n): every phrase of up to four words that occurs ``least`` times, and under size 0 the words of a language."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    common = common_words(docs)
    weight = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / 6 / PART_EDGES))
    found = written(flows(edges(docs, common, parts), least, common), "flows")
    summed = found.where("part").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    whole = found.where("not part").select("lang", "size", "phrase", "n").unionByName(summed.where(F.col("n") >= least))
    words = found.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "n")
    return written(whole.unionByName(words), "phrases")


def paths(counts: DataFrame) -> DataFrame:
    """(lang, words, n): the frequent edges, compacted along unary paths.

    An edge goes on to the next one where both have the count of the node between them: then every occurrence of the one is
    followed by the other. Edges of a path have one count. The rounds grow with the logarithm of the longest path; no path
    is longer than a piece, and none is closed, as pieces end.
    """
    words = F.split("phrase", " ")
    edge = counts.where("size = 4").select("lang", "phrase", "n", F.array_join(F.slice(words, 1, 3), " ").alias("source"), F.array_join(F.slice(words, 2, 3), " ").alias("target"))
    node = counts.where("size = 3").select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    into = edge.select("lang", F.col("target").alias("node"), F.col("phrase").alias("before"), "n").join(node, ["lang", "node"]).where("n = flow").select("lang", "node", "before")
    out = edge.select("lang", F.col("source").alias("node"), "phrase", "n").join(node, ["lang", "node"]).where("n = flow").select("lang", "node", "phrase")
    links = into.join(out, ["lang", "node"]).select("lang", "phrase", "before")
    # each edge points to an earlier one of its path, and knows how far back it is; the pointers double
    at = edge.select("lang", "phrase", "n").join(links, ["lang", "phrase"], "left").select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("place"))
    at = checkpointed(at)
    while True:
        jump = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        at = checkpointed(at.join(jump, ["lang", "head"]).select("lang", "phrase", "n", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    last = F.element_at(words, -1)
    grouped = at.groupBy("lang", "head").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", last.alias("word")))).alias("r"))
    tail = F.transform(F.filter("r", lambda r: r["place"] > 0), lambda r: r["word"])
    return grouped.select("lang", F.concat(F.split("head", " "), tail).alias("words"), "n")


def _inside(words, size: int):
    """All runs of ``size`` words of an array of words, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to 4 words.

    A-Z is lower-cased; texts fall into pieces at .,;:!? and line ends, pieces into words at space and tab. a counts the
    phrase, n all words of the language. The score is floor(2000000 * a / (l + r)) of the lowest cut into a first part (l) and
    a rest (r), the first of equals. Phrases with ``covered`` per cent of their occurrences inside a longer one that occurs
    ``least`` times go. High scores come first, then high a, then the phrase in byte order. A null text is empty, a null lang
    is `und`; repeated rows count each. ``docs`` needs lang and text; other columns are ignored. No words give no rows.
    """
    counts = phrase_counts(docs, least)
    chains = written(paths(counts), "paths")
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    longer = chains.select("lang", "n", F.explode(F.concat(_inside(F.col("words"), 3), _inside(F.col("words"), 2))).alias("phrase"))
    triples = counts.where("size = 3").select("lang", "n", F.explode(_inside(words, 2)).alias("phrase"))
    covers = longer.unionByName(triples).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    wide = lambda c: c.cast("decimal(38,0)")
    left = candidates.join(covers, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide(F.col("most")) * 100 < wide(F.col("a")) * covered))
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("rest"))
    cuts = left.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    of = counts.where("size >= 1").select("lang", "phrase", "n")
    cuts = cuts.join(of.withColumnsRenamed({"phrase": "first", "n": "l"}), ["lang", "first"]).join(of.withColumnsRenamed({"phrase": "rest", "n": "r"}), ["lang", "rest"])
    exact = F.expr("cast(cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) as bigint)")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", "n")
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
