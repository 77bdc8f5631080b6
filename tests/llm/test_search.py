"""Hard negatives, neighbours and collocations against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import collocations, graphsearch, hardnegatives, onebit, queries

MORE = ", key long, ids string, shard int, words string, label_x int"


def vectors(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, 1, "x", 2, "w", 3) for r in rows], f"vec_id long, label int, vector array<{kind}>{MORE}")


def negatives_of(rows, every=100, high=90):
    """The contract, pair by pair."""
    rows = sorted({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v and None not in v})
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, y, v in rows:
        if i % every:
            continue
        alike = [w for w in rows if len(w[2]) == len(v)]
        first = sorted(((-dot(v, w[2]), w[0]) for w in alike if w[1] == y and w[0] != i))[:5]
        for s, p in first:
            found = sorted((-n, w[0]) for w in alike if w[1] != y for n in [dot(v, w[2])] if -30 * s <= 100 * n <= -high * s)[:10]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(found)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(3), [rnd.randint(-60, 60) for _ in range(24)]) for i in range(400)]
    same = rows[7][2]
    rows += [(400 + i, i % 2, same) for i in range(60)]  # a large group of equal vectors: ties by id
    rows += [rows[0], rows[0], (100, 5, rows[3][2]), (None, 1, same), (901, None, same), (902, 1, None), (903, 1, [1, None]), (904, 1, []), (905, 1, [0] * 24), (1000, 1, [3] * 24), (1000, 1, [2, 5, 1]), (906, 2, [1, 1, 1]), (907, 1, [2, 2, 2])]
    want = negatives_of(rows)
    assert len(want) > 100
    got = mined(hardnegatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == want
    assert mined(hardnegatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, cell_rows=50, cell_anchors=2, levels=1)) == want


def test_hard_negatives_of_large_numbers(spark):
    rnd = random.Random(5)
    rows = [(i, i % 2, [rnd.randint(-(1 << 30), 1 << 30) for _ in range(5)]) for i in range(150)]
    assert mined(hardnegatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0)) == negatives_of(rows)


def test_hard_negatives_of_nothing(spark):
    out = hardnegatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not out.collect()
    assert not hardnegatives.hard_negatives(vectors(spark, [(100, 1, [1, 2])]), F.col("vec_id") % 100 == 0).collect()


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_every_product(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-300, 300, (200, dim))
    x[0] = 0
    x[1:4] = x[5]
    for levels in (1, 4):
        estimate, half = onebit.intervals(onebit.ask(x[:40], levels), onebit.encode(x, levels))
        assert (np.abs(estimate - x[:40] @ x.T) <= half).all()
    wide = rng.normal(size=(500, 64)) * 100
    estimate, half = onebit.intervals(onebit.ask(wide[:20]), onebit.encode(wide))
    assert (half < 0.25 * np.linalg.norm(wide[:20], axis=1)[:, None] * np.linalg.norm(wide, axis=1)).all()  # they do filter


def near(rows, every=50, most=5):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for n, (i, v) in enumerate(ok):
        if i % every == 0:
            q = np.array(v)
            found = [(-float(graphsearch.cosines(q[None], np.array(w)[None])[0]), j) for j, w in ok if j != i and len(w) == len(v)]
            out[i, n] = [(j, -s) for s, j in sorted(found)[:most]]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # ties by id
    rows += [rows[0], (400, None), (450, [0.0] * 8), (451, [None] * 8), (452, [math.nan] * 8), (453, [math.inf] * 8), (None, rows[0][1]), (500, [1.0, 2.0]), (501, [1e-3, 2e-3]), (550, [5.0]), (454, [])]
    rows += [(600, [1e200, 0.0, 1.0]), (601, [1e-200, 0.0, 0.0]), (602, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, vector array<double>, key long, ids string, shard int")
    got = defaultdict(list)
    for r in graphsearch.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=64, beam=400).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = near(rows)
    assert {k for k, _ in want} == set(got) | {550}
    for (i, _), found in want.items():
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, len(found) + 1))
        assert [j for _, j, _ in mine] == [j for j, _ in found] and [s for _, _, s in mine] == [s for _, s in found]


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert graphsearch.neighbours(df, F.col("vec_id") % 50 == 0).columns == ["query_id", "rank", "vec_id", "score"]
    assert not graphsearch.neighbours(df, F.col("vec_id") % 50 == 0).collect()
    alone = spark.createDataFrame([(50, [1.0])], "vec_id long, vector array<float>")
    assert not graphsearch.neighbours(alone, F.col("vec_id") % 50 == 0).collect()


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(set)
    for r in queries.QUERIES["op13_neighbours"](spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-score)[:5]].tolist())) / 5)
    assert len(hits) == 40 and np.mean(hits) >= 0.9


def test_a_graph_keeps_diverse_edges_and_finds_its_points():
    x = graphsearch.unit(np.random.default_rng(2).normal(size=(1500, 32))).astype(np.float32)
    graph, entry = graphsearch.build(x, degree=24)
    assert graphsearch.reached(graph, entry).all() and not any(i in row for i, row in enumerate(graph.tolist()))
    assert all(len(set(row) - {-1}) == sum(v >= 0 for v in row) for row in graph.tolist())
    ids, _ = graphsearch.beam_search(x, graph, entry, x, 64)
    assert (ids[:, 0] == np.arange(1500)).mean() > 0.99
    copies = np.repeat(x[:5], 100, axis=0)
    graph, entry = graphsearch.build(copies)
    assert graphsearch.reached(graph, entry).all()


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, least, covered=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * cand[p[i : i + k]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def talk(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "of", "the", "É", "é", "x-y", "　z", "'", "\x00q", "\x1cr"]
    line = "a long passage that many texts share word by word without an end of it"
    rows = [(rnd.choice(["en", "de", None]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", "  "]) for _ in range(rnd.randint(0, 80)))) for _ in range(150)]
    rows += [("en", f"{line} {i % 7}") for i in range(40)] + [("en", line.upper())] * 9
    rows += [(None, None), ("de", ""), ("", "a b " * 40), ("en", " . ;"), ("fr", "the of " * 20000), ("a\tb", "x " * 50), ("en", "w" * 50000)]
    return rows


@pytest.mark.parametrize("least", [3, 12])
def test_collocations_against_counting(spark, least):
    rows = talk(least)
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "lang string, text string, n long, phrase string").repartition(5)
    want = phrases(rows, least)
    assert len(want) > 100
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == want
    few = collocations.collocations(df, least=least, top=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in few.collect()) == [r for r in want if r[1] <= 3]


def test_common_pairs_are_dealt_out_and_counted_whole(spark):
    rows = talk(1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    common = frozenset([b"the", b"of", b"a", b"b"])
    blocks = collocations.edges(df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), common, 16)
    found = collocations.flows(blocks, 1, common).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    f = {(r.lang, r.phrase): (r.n, r.parts) for r in found.where("size = 2").collect()}
    count = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            count.update(((lang if lang is not None else "und"), " ".join(p)) for p in zip(w, w[1:]))
    assert {k: n for k, (n, _) in f.items()} == dict(count)
    assert f["en", "a b"][1] > 1


def test_a_passage_is_one_path(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([("en", line)] * 5 + [("en", "three four five six seven " + w) for w in ("p", "q")], "lang string, text string")
    found = {tuple(r.words): r.n for r in collocations.paths(collocations.phrase_counts(df, 2)).collect()}
    w = line.split()
    assert found == {tuple(w[:5]): 5, tuple(w[2:7]): 7, tuple(w[4:]): 5}


def test_collocations_of_nothing(spark):
    out = collocations.collocations(spark.createDataFrame([], "lang string, text string"))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not out.collect()
    assert not collocations.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).collect()
