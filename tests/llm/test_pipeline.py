"""The pipeline against its stages in plain Python, and the registered queries on the smallest tables."""

import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from check_queries import connect, rows_of
from palimpsest.llm import packing, queries
from test_free import FOLD, WORD, Union, edits, prose, sets
from test_native import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    root = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rnd, rnd.randint(14, 30))) for i in range(5)]
    shared = [prose(rnd, 55) for _ in range(3)]
    docs, labels = [], []
    for i in range(300):
        text = "\n".join(prose(rnd, rnd.randint(6, 40)) for _ in range(rnd.randint(1, 6)))
        good = i % 5 != 0
        if not good:
            text = " ".join(w + rnd.choice(["###", "%%%", "!!"]) for w in text.upper().split(" "))
        elif i % 7 == 0:
            text += "\n" + rnd.choice(shared)
        elif i % 11 == 0:
            text += "\n" + rnd.choice(items)[1].upper() + "."
        elif i % 13 == 0 and i > 20:
            w = docs[i - 3][1].split(" ")
            w[len(w) // 2] = "other"
            text = " ".join(w)
        docs.append((i, text, "en" if i % 3 else None, f"src{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(400, None, "en", None, None), (401, "", "en", "s", 0), (402, docs[1][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stage_order_and_columns(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_keep_columns_of_any_name(spark, folder):
    names = ["score", "Predicted", "drop_id", "drop_key", "drop_numbers", "Drop_Numbers_", "gone_id", "hit_id", "hit_key", "text_key", "numbers", "numbers "]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.select("doc_id", *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).collect()
        assert rows and all(r[f"c{i}"] == (None if r.doc_id is None else f"{i}-{r.doc_id}") for r in rows for i in range(len(names)))


def test_pipeline_against_plain_python(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = corpus_pipeline.quality.scored(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert np.mean([(r.doc_id % 5 != 0) == (r.predicted == 1) for r in scored if r.doc_id < 300]) > 0.95
    left = {r.doc_id: r.text for r in scored if r.predicted == 1}
    # lines
    found = [(d, n, x.encode()) for d in sorted(left) for n, x in enumerate((left[d] or "").translate(FOLD).split("\n")) if len(WORD.findall(x)) >= 5]
    classes, lines = Union(), sorted({x for _, _, x in found})
    for i, x in enumerate(lines):
        classes.find(x)
        for y in lines[:i]:
            if min(len(x), len(y)) >= 40 and abs(len(x) - len(y)) <= 2 and edits(x[:12], y[:12]) <= 4 and edits(x, y) <= 2:
                classes.join(x, y)
    seen, drop = set(), defaultdict(set)
    for d, n, x in found:
        if classes.find(x) in seen:
            drop[d].add(n)
        seen.add(classes.find(x))
    for d, numbers in drop.items():
        left[d] = "\n".join(x for n, x in enumerate(left[d].split("\n")) if n not in numbers)
    assert drop
    left = {d: t for d, t in left.items() if d not in drop or t.strip()}
    # near copies
    shingles, groups = {d: sets(t, 4) for d, t in left.items()}, Union()
    for a in left:
        groups.find(a)
        for b in left:
            both = len(shingles[a] & shingles[b])
            if b < a and both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
                groups.join(a, b)
    left = {d: t for d, t in left.items() if groups.find(d) == d}
    # benchmark
    windows = {tuple(w[i : i + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()) for i in range(len(w) - 9)}
    hit = {d for d, t in left.items() for w in [words(t)] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    assert hit
    left = {d: t for d, t in left.items() if d not in hit}
    # packing
    tokenizer, got = Tokenizer.from_file(packing.tokenizer_file()), defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(left)
    for d, pieces in got.items():
        ids, at = np.array([*tokenizer.encode(left[d] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    out = queries.QUERIES[name](spark, SF)
    got = rows_of(out.columns, [tuple(r) for r in out.collect()])
    res = connect(SF).execute(queries.ORACLES[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert want[1] and got == want


def test_one_query_for_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
