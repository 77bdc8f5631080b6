"""Fingerprints, near-duplicates, lines, packing, quality, sharding and language against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import fingerprints, langid, linededup, neardedup, packing, quality, queries, rolling, sharding, stars

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t", "one", "One two", "É é x", "a\n\nb", "x" * 3000, "word " * 9000, "  z", "İ J̌ don't <|endoftext|>"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def mixed(seed, n=60):
    """Odd texts, copies, near copies, a chain of near copies."""
    rnd = random.Random(seed)
    texts = list(ODD)
    base = prose(rnd, 120)
    for i in range(n):
        kind = i % 4
        if kind == 0:
            texts.append(prose(rnd, rnd.randint(1, 200)))
        elif kind == 1:
            w = base.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(rnd.choice(texts))
        else:
            w = (texts[-1] or base).split() or ["x"]
            for _ in range(1 + len(w) // 40):
                w[rnd.randrange(len(w))] = prose(rnd, 1)
            texts.append(" ".join(w).upper() if i % 3 else " ".join(w))
    return texts


def frame(spark, rows, more="lang string, low long, score double, u long"):
    return spark.createDataFrame([(*r, "en", 1, 2.0, 3) for r in rows], f"doc_id long, text string, {more}")


def sets(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_shingle_sets_match_plain_python():
    texts = mixed(1)
    for size in (1, 4, 5):
        found = list(rolling.shingle_sets(pa.array(texts), size))
        want = [sets(t, size) for t in texts]
        assert [len(f) for f in found] == [len(w) for w in want]
        for i in range(0, len(texts), 3):
            for j in range(0, len(texts), 5):
                assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_likeness_is_near_jaccard():
    rnd = random.Random(2)
    errors = []
    for i in range(150):
        a = prose(rnd, 300).split()
        b = a[: i * 2] + prose(rnd, 300 - i * 2).split()
        one, two = (fingerprints.fingerprints([" ".join(x)]) for x in (a, b))
        x, y = sets(" ".join(a), 5), sets(" ".join(b), 5)
        errors.append(float(fingerprints.alike(one, two)[0]) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15


def test_fingerprint_query_follows_the_order_of_ids(spark):
    texts = mixed(3)
    ids = random.Random(4).sample(range(1000), len(texts))
    rows = sorted(zip(ids, texts))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if t == after:
            assert got[d].near_next == 1
    by = defaultdict(set)
    for d, t in rows:
        by[t or ""].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in by.values())
    few = fingerprints.fingerprint_edits(frame(spark, [(None, "a b"), (None, None), (5, "q r"), (5, "q r")])).collect()
    assert len(few) == 4
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    assert [r.n_chars for r in fingerprints.fingerprint_edits(frame(spark, [(None, "abcd")])).collect()] == [4]


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = Union()
    for a, b in links:
        if a != b:
            want.join(a, b)
    assert got == {n: want.find(n) for n in want}
    for few in (5, 40):  # rounds over several tasks
        df = spark.createDataFrame(links, "a long, b long").repartition(7)
        assert {r.node: r.root for r in stars.components(df, few).collect()} == got
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_hubs_and_blocks_lose_no_component(spark, block):
    """Large buckets whose links form chains, pairs and nothing: far from a star around the first node."""
    members = [(1, n) for n in range(40)] + [(2, n) for n in range(30, 60)] + [(3, n) for n in range(60, 63)] + [(4, n) for n in range(200, 260)]
    truth = {(n, n + 7) for n in range(0, 33, 2)} | {(n, n + 1) for n in range(40, 55)} | {(60, 62), (61, 62)}
    truth |= {(200, n) for n in range(201, 240)} | {(230, 250), (251, 252)}

    def verify(pairs):
        return spark.createDataFrame([(r.a, r.b) for r in pairs.collect() if (r.a, r.b) in truth], "a long, b long")

    def similar(left, right):
        pairs = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right or left) if (min(x, y), max(x, y)) in truth and (right or i < j)]
        return tuple(np.array([p[k] for p in pairs], int) for k in (0, 1))

    payload = spark.createDataFrame([(n, n) for n in range(300)], "node long, payload long")
    roots, _ = stars.linked(spark.createDataFrame(members, "bucket long, node long"), verify, payload, similar, block=block)
    got = {r.node: r.root for r in roots.collect()}
    want = Union()
    for a, b in truth:
        if any({a, b} <= {n for k, n in members if k == bucket} for bucket in range(1, 5)):
            want.join(a, b)
    assert got == {n: want.find(n) for n in want}


def test_similar_sets_and_lines():
    rnd = random.Random(20)
    base = [rnd.getrandbits(62) for _ in range(60)]
    sets_ = [np.unique(np.array(base[: rnd.randint(45, 60)] + [rnd.getrandbits(62) for _ in range(rnd.randint(0, 6))], np.uint64)) for _ in range(40)]
    data = [s.tobytes() for s in sets_]

    def ok(x, y):
        both = len(np.intersect1d(x, y))
        return 100 * both >= 80 * (len(x) + len(y) - both)

    i, j = neardedup.similar_sets(data, None, 80)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(40) for b in range(a + 1, 40) if ok(sets_[a], sets_[b])}
    i, j = neardedup.similar_sets(data[:15], data[15:], 80)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b - 15) for a in range(15) for b in range(15, 40) if ok(sets_[a], sets_[b])}
    line = prose(rnd, 12).encode()
    lines = [changed(rnd, line, rnd.randint(0, 3)) for _ in range(40)]
    i, j = linededup.similar_lines(lines, None, 2)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(40) for b in range(a + 1, 40) if edits(lines[a], lines[b]) <= 2}
    i, j = linededup.similar_lines(lines[:9], lines[9:], 2)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b - 9) for a in range(9) for b in range(9, 40) if edits(lines[a], lines[b]) <= 2}


def test_near_duplicates_against_brute_force(spark):
    texts = mixed(6, 90)
    rows = list(enumerate(texts))
    want = Union()
    shingles = [sets(t, 4) for t in texts]
    for i in range(len(texts)):
        want.find(i)
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both and 100 * both >= 80 * len(shingles[i] | shingles[j]):
                want.join(i, j)
    table = frame(spark, [*rows, (None, texts[-1]), (None, None)])
    got = neardedup.near_duplicates(table).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(shingles[r.doc_id]), want.find(r.doc_id), want.find(r.doc_id) == r.doc_id)
    left = neardedup.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted({want.find(i) for i in range(len(texts))})
    assert neardedup.near_duplicates(frame(spark, [])).count() == 0
    twice = neardedup.near_duplicates(frame(spark, [(4, "a b c d e"), (4, "a b c d e"), (4, "p q r s t"), (9, "p q r s t")])).collect()
    assert {(r.doc_id, r.component_id) for r in twice} == {(4, 4), (9, 4)} and len(twice) == 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, line, n):
    b = bytearray(line)
    for _ in range(n):
        at, kind = rnd.randint(0, len(b)), rnd.randint(0, 2)
        if kind == 0:
            b.insert(at, rnd.choice(b"abc"))
        elif at < len(b):
            b[at : at + 1] = b"" if kind == 1 else bytes([rnd.choice(b"abc")])
    return bytes(b)


@pytest.mark.parametrize("threshold", [0, 1, 2, 5])
def test_banded_edit_distance(threshold):
    rnd = random.Random(threshold)
    a = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    b = [changed(rnd, x, rnd.randint(0, 7)) for x in a]
    assert linededup.within(a, b, threshold).tolist() == [edits(x, y) <= threshold for x, y in zip(a, b)]


def test_lines_against_brute_force(spark):
    rnd = random.Random(8)
    base = [prose(rnd, rnd.randint(3, 30)) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [rnd.choice(["", "short one", "  "])]
        for _ in range(rnd.randint(0, 5)):
            line = rnd.choice(base).encode()
            lines.append(changed(rnd, line, rnd.choice([0, 0, 1, 2, 4])).decode())
        lines.append(prose(rnd, 12))
        rows.append((d, "\n".join(lines).upper() if d % 7 == 0 else "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (104, base[0] + "\n" + base[0]), (None, base[1] + " é")]
    found = [(d, n, x.encode()) for d, t in rows for n, x in enumerate(t.translate(FOLD).split("\n") if t is not None else []) if len(WORD.findall(x)) >= 5]
    found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    classes, lines = Union(), sorted({x for _, _, x in found})
    for i, x in enumerate(lines):
        classes.find(x)
        for y in lines[:i]:
            if min(len(x), len(y)) >= 40 and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2:
                classes.join(x, y)
    drop, seen = defaultdict(list), set()
    for d, n, x in found:
        root = classes.find(x)
        if root in seen:
            drop[d].append(n)
        seen.add(root)
    table = frame(spark, rows)
    got = linededup.line_report(table).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.dropped) == (0 if text is None else text.count("\n") + 1, len(drop[r.doc_id]), ",".join(map(str, drop[r.doc_id])))
    left = linededup.dedupe_lines(table)
    assert left.columns == table.columns
    want = {}
    for d, t in rows:
        kept = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[d])
        if not drop[d] or kept.strip():
            want[d] = kept
    assert {r.doc_id: r.text for r in left.collect()} == want
    assert linededup.line_report(frame(spark, [])).count() == 0


def test_short_and_unspaced_lines_are_deduped(spark, tmp_path):
    han = "".join(chr(0x4E00 + i * 7) for i in range(60))
    rows = [(1, f"all rights\n{han}\n \n1."), (2, f"All Rights\n{han}\n \n2."), (3, han[:30] + han[31:])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.dropped for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert (got[1], got[2]) == ("", "0,1")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, frame(spark, rows[:2]), "").collect()}
    assert left == {1: rows[0][1], 2: " \n2."}


def test_near_lines_count_characters_and_have_no_least_size(spark, tmp_path):
    rnd = random.Random(12)
    letters = "abcé’'—\u4e2d\u6587\U0001f600"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 30))) for _ in range(200)]
    more = []
    for x in base:
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(x))
            x = x[:at] + rnd.choice(["", rnd.choice(letters)]) + x[at + rnd.randint(0, 1) :]
        more.append(x)
    a, b = [x.encode() for x in base], [x.encode() for x in more]
    assert linededup.within(a, b, 2, True).tolist() == [edits(x, y) <= 2 for x, y in zip(base, more)]
    i, j = linededup.similar_lines(a[:40], b[:40], 2, True)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(40) for y in range(40) if edits(base[x], more[y]) <= 2}
    han = "".join(chr(0x4E00 + i * 7) for i in range(40))
    long = "it was the dog's own house on that old hill"
    pairs = [("thwhesnd esator whshing and hewh.", "thwhesnd, esator whshing and hewh."), ("a b c d e", "a b c d f"), (han, han[:9] + "\u597d" + han[9:])]
    pairs += [(long, long.replace("'", "’")), ("le café était fermé hier soir", "le cafe etait fermé hier soir"), ("one two six ten old", "one two sax tan ald")]
    frame(spark, [(n, "\n".join(p[n] for p in pairs)) for n in (0, 1)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.dropped for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0,1,2,3,4"}


def test_no_shard_of_small_groups_is_above_the_capacity(spark):
    docs = frame(spark, [(i, f"text {i} " + "x" * (i % 40)) for i in range(3000)])
    for options in ({"per_bin": 4, "cells": 2}, {"per_bin": 1, "cells": 2}):
        got = sharding.shard(docs, None, 500, **options).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) <= 500


def test_differencing_is_even_and_rises_with_need():
    rnd = random.Random(9)
    sizes = [rnd.randint(1, 256) for _ in range(300)]
    window, sums = packing.difference(sizes, 16)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 32
    assert sums.tolist() == [sum(s for s, w in zip(sizes, window) if w == k) for k in range(16)]
    assert len(set(packing.deal([60, 60, 60], 100).tolist())) == 3  # two windows would do by size, not by fit


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(10)
    texts = mixed(10, 40) + [prose(rnd, 6000) + " don't Ⅷ½ ΑΒΓ" for _ in range(3)]
    rows = list(enumerate(texts)) + [(1000, "again"), (1000, "again"), (None, "no id")]
    path = packing.tokenizer_file()
    got = packing.pack(frame(spark, rows).repartition(3), path, capacity=256, ways=4, piece=32, slack=2).collect()
    tokenizer = Tokenizer.from_file(path)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == {d for d, _ in rows}
    for d, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        pieces = sorted(docs[d], key=lambda r: r.start)
        for r in pieces[:: 2 if d == 1000 else 1]:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(frame(spark, []), path).count() == 0


def labelled(spark, n=400):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rnd, rnd.randint(20, 120))
        docs.append((i, text if good else " ".join(w + rnd.choice(["###", "%%%"]) for w in text.split())))
        labels.append((i, int(good), 0))
    return frame(spark, docs + [(None, "x y z"), (5000, None), (5001, ""), (5002, "word " * 20000)]), spark.createDataFrame(labels + [(3, None, 1)], "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_factorisation_machine_equals_its_double_sum():
    rnd = np.random.default_rng(12)
    model = rnd.normal(size=(50, 5)).astype(np.float32)
    index, value = np.array([3, 7, 9, 20, 41]), rnd.normal(size=5).astype(np.float32)
    plain = float((model[index, 0] * value).sum())
    for i in range(5):
        for j in range(i):
            plain += float(model[index[i], 1:] @ model[index[j], 1:]) * value[i] * value[j]
    assert abs(quality._margin(model, np.array([0, 5]), index, value)[0][0] - plain) < 1e-4


def test_best_fit_and_its_tree():
    rnd = random.Random(13)
    tree, plain = sharding.Tree(), []
    for _ in range(3000):
        key = (rnd.randint(0, 60), rnd.randint(0, 60))
        if rnd.random() < 0.6 and key not in plain:
            tree.add(key)
            plain.append(key)
        elif key in plain:
            tree.remove(key)
            plain.remove(key)
        probe = (rnd.randint(0, 60), -1)
        assert tree.least(probe) == min((k for k in plain if k >= probe), default=None)
    sizes = [rnd.randint(1, 70) for _ in range(200)]
    room = []
    want = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[at]]
        if fits:
            want[at] = min(fits)[1]
        else:
            want[at] = len(room)
            room.append(100)
        room[want[at]] -= sizes[at]
    assert sharding.best_fit(sizes, 100) == want
    assert max(sharding.tightest(sizes, 8)[1]) == 7 and sharding.best_fit([], 5) == []


def test_shards(spark):
    texts = mixed(14, 200)
    rows = list(enumerate(texts)) + [(7, "same"), (7, "same"), (None, "same")]
    got = sharding.shard(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    text_of, slots, groups = dict(enumerate(texts)), defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None and r.doc_id != 7:
            data = (text_of[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
            groups[text_of[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert all(len(g) == 1 for g in groups.values())
    capped = sharding.shard(frame(spark, rows), None, capacity=50_000)
    assert capped.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 50_000
    assert sharding.shard(frame(spark, []), 4).count() == 0


def test_language_evidence(spark):
    rnd = random.Random(15)
    letters = {"aa": "abcdefg", "bb": "mnopqrs"}

    def say(lang, n):
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(4)) for _ in range(n))

    docs = spark.createDataFrame([(i, say(k, 60), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    page = lambda lang, text: f'<html lang="{lang}"><script>var zzz;</script><p>{text}</p></html>'
    rows = [(i, f"http://h{i % 4}.example.{'aaa' if i % 2 else 'bbb'}/x", page(k, say(k, 40))) for i, k in enumerate(["bb", "aa"] * 60)]
    rows += [(500, "http://h1.example.aaa/y", page("aa", "")), (501, None, page("bb", "")), (502, None, None), (503, "", page("aa", say("bb", 300))), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, lang string")
    got = langid.identify(table, docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == ("aa" if i % 2 else "bb") for i in range(120))
    assert by[500].lang == "aa" and by[501].lang == "bb"  # host, suffix and markup where there is no text
    assert by[503].lang == by[503].text_lang == "bb" and by[503].declared == "aa"  # much text outweighs one declaration
    assert by[502].lang in ("aa", "bb") and 0.5 <= by[502].probability <= 1
    assert langid.identify(table.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(table, docs.limit(0)).collect()} == {None}
