"""Golden rows for text functions."""

import hashlib
import unicodedata

from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_function_results_of_any_depth(spark):
    deep = "function result: " + "{" * 9 + "x" + "}" * 9 + " tail"
    rows = spark.createDataFrame([("a function result: {1:{2}} b",), (deep,), ("function result: {open",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.filter_function_result("t")).collect()] == ["a function result: [result] b", "function result: [result] tail", "function result: {open", None]


def test_pre_sanitize_masks_known_fences_only(spark):
    assert one(spark, X.pre_sanitize(F.lit("a ~~~action\n{1}~~~ b ~~~other {2}~~~"))) == "a [cmd] b ~~~other {2}~~~"
    assert one(spark, X.filter_memory_content(F.lit("function result: {a} ~~~x~~~"))) == "function result: [result] [cmd]"


def test_sentences_cjk_and_latin(spark):
    got = one(spark, X.split_sentences(F.lit("One. Two!Three?  四。五！六\n\n")))
    assert got == ["One.", "Two!Three?", "四。", "五！", "六\n\n"]


def test_sanitize_punct_keeps_fences(spark):
    text = "a - b -- c\nd ~~~x\ny~~~\ne\n\n\n\nf ,, g"
    assert one(spark, X.sanitize_punct(F.lit(text))) == "a, b, c\n\nd ~~~x\ny~~~\n\ne\n\nf, g"


def test_concat_roles(spark):
    text = "[251007Tue 13:28] User: hi\nUser: there\n\nmore\nAssistant: yo\nAssistant: \n[251007Tue 13:40]\nAssistant: z\nnarration"
    want = "[251007Tue 13:28] User: hi\nthere\nmore\nAssistant: yo\n[251007Tue 13:40]\nAssistant: z\nnarration"
    assert one(spark, X.concat_roles(F.lit(text))) == want
    assert one(spark, X.concat_roles(F.lit("lost line\nUser: a"))) == "lost line\nUser: a"


def test_norms(spark):
    assert one(spark, X.detector_norm(F.lit("  你好，世界！  Hi "), "-")) == "你好,世界! hi-"
    assert one(spark, X.alias_norm(F.lit(" Ｆｏｏ_(Bar).  ｶﾞ x-y "))) == "foo bar ガ x-y"
    assert one(spark, X.alias_key(F.lit("Café "))) == one(spark, X.alias_key(F.lit("cafe")))
    assert one(spark, X.normalize_nfc(F.lit(" é\r\nx "))) == "é\nx"


def test_tokens(spark):
    assert one(spark, X.tokenize_cjk(F.lit("The big 猫 and a猫 dog_1 x big"))) == ["big", "dog_1", "猫"]
    assert one(spark, X.rough_tokens(F.lit("猫猫 abcd"))) == 4  # 2 + ceil(5 / 4)


def test_json_lenient(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("{“a”: [1,],}",), ("{oops}",), ('{"a":1} x',), ("5",)], "t string")
    got = [r[0] for r in rows.select(X.json_lenient("t")).collect()]
    assert got == ['{"a":1}', '{"a": [1]}', None, None, None]


def test_recency(spark):
    now = F.lit("2024-01-08").cast("timestamp")
    w = lambda s: one(spark, X.recency_weight(F.lit(s).cast("timestamp"), now))
    assert w("2024-01-01") == 0.5 and w("2024-02-01") == 1.0 and w(None) == 0.5


def plain_simhash(text):
    v = [0] * 64
    for i in range(len(text) - 1):
        h = int.from_bytes(hashlib.blake2b(text[i : i + 2].encode(), digest_size=8).digest(), "big")
        for b in range(64):
            v[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if v[b] > 0)


def test_simhash_equals_definition(spark):
    texts = ["hello world", "", "a", "aa", "猫 and 犬 😀😀", unicodedata.normalize("NFD", "éà"), "x" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.hex64(H.simhash64("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: f"{plain_simhash(t):016x}" for t in texts}


def test_ids(spark):
    long = "c" * 40
    assert one(spark, H.normalize_id(F.lit(long), "n_")) == ("n_" + long)[:28] + hashlib.md5(("n_" + long).encode()).hexdigest()[:4]
    short = one(spark, H.normalize_id(F.lit("n_x"), "n_"))
    assert short == "n_x" + hashlib.md5(b"n_x_pad").hexdigest()[:29] and len(short) == 32
    assert len(one(spark, H.alias_id(F.lit("n_" + "a" * 30), F.lit("Bob")))) == 32
