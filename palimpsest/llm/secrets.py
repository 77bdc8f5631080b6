"""Secret scan with a random forest that takes out false positives, in column expressions and Spark's own forest only.

Candidates are long strings with a digit, keys of a known form, and what stands after a secret's name and ``=`` or ``:``, from
LEAST_NAMED characters on. The forest looks at a candidate's length and kinds of characters, at how usual its
character transitions are in the corpus, at how much of it common words cover, at its path and at the words beside it. It
is trained on labelled findings, of which at most ``sample`` are used.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.shared import let, written

LEAST = 12
LEAST_NAMED = 4
CANDIDATE = r"[A-Za-z0-9+/_@.\-]{12,}"
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private")
KNOWN = "AKIA[0-9A-Z]{14,18}|gh[pousr]_[A-Za-z0-9]{30,}|xox[bap]-[A-Za-z0-9-]{10,}"
#: A secret's name, '=' or ':', and what may stand between that and the value.
NAMED = rf"(?:{'|'.join((*KEYWORDS, 'passphrase'))})[\w\-]*\W*[=:][^A-Za-z0-9+/_@.\-]*"
NAMED_VALUE = rf"(?i)({NAMED})([A-Za-z0-9+/_@.\-]{{{LEAST_NAMED},}})"
FIRST_VALUE = rf"^([^A-Za-z0-9+/_@.\-]*)([A-Za-z0-9+/_@.\-]{{{LEAST_NAMED},}})"
STRUCT = T.StructType([T.StructField("value", T.StringType()), T.StructField("lead", T.StringType()), T.StructField("least", T.IntegerType())])
SAMPLE = 20_000
TREES, DEPTH, SEED = 32, 6, 7
#: A word that occurs so often is common.
COMMON = 20
FEATURES = (
    "size digits uppers lowers others changes variety hex transitions covered path_rate path_digits keyword_near assigned quoted before_common after_common".split()
)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, word_at, value, lead, before, before2, after) of every candidate of every text.

    Words are separated by white space; a word may hold several candidates. ``lead`` is what stands before the value in its word.
    """

    def of_word(words: Column, i: Column) -> Column:
        word = F.get(words, i)
        before, before2, after = (F.coalesce(F.get(words, i + k), F.lit("")) for k in (-1, -2, 1))
        values = F.filter(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)), lambda v: v.rlike("[0-9]") | v.rlike(KNOWN))
        long = F.transform(values, lambda v: F.struct(v.alias("value"), F.call_function("substring_index", word, v, F.lit(1)).alias("lead"), F.lit(LEAST).alias("least")))

        def other(value: Column, lead: Column) -> Column:
            return F.struct(value.alias("value"), lead.alias("lead"), F.lit(LEAST_NAMED).alias("least"))

        named = F.zip_with(*(F.regexp_extract_all(word, F.lit(NAMED_VALUE), F.lit(k)) for k in (2, 1)), other)
        lead = F.regexp_extract(word, FIRST_VALUE, 1)
        follows = F.lower(F.concat_ws(" ", before2, before, lead)).rlike(f"{NAMED}$") & (F.regexp_extract(word, FIRST_VALUE, 2) != "")
        first = F.when(follows, F.array(other(F.regexp_extract(word, FIRST_VALUE, 2), lead))).otherwise(F.array().cast(T.ArrayType(STRUCT)))
        # a run that is a candidate for its digits already keeps that entry
        short = F.filter(F.concat(named, first), lambda c: ~F.array_contains(values, c["value"]))
        found = F.transform(
            F.concat(long, short),
            lambda c: F.struct(
                i.alias("word_at"),
                F.regexp_replace(c["value"], r"[.\-/_]+$", "").alias("value"),
                c["lead"].alias("lead"),
                before.alias("before"),
                before2.alias("before2"),
                after.alias("after"),
                c["least"].alias("least"),
            ),
        )
        return F.filter(found, lambda c: F.length(c["value"]) >= c["least"])

    def may(words: Column, i: Column) -> Column:
        word = F.get(words, i)
        long = (F.length(word) >= LEAST) & (word.rlike("[0-9]") | word.rlike(KNOWN))
        return long | word.rlike("[=:]") | F.coalesce(F.get(words, i - 1), F.lit("")).rlike(r"[=:][^A-Za-z0-9+/_@.\-]*$")

    some = docs.where(F.col("text").rlike("[0-9=:]") | F.col("text").rlike(KNOWN))
    at = let(
        F.split("text", r"\s+"),
        lambda w: F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: may(w, i)), lambda i: of_word(w, i))),
    )
    return some.select("doc_id", "path", F.explode(at).alias("c")).select("doc_id", "path", "c.*").drop("least")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every run of letters of the whole corpus, lower-cased, from two characters on."""
    all_ = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 2)
    return all_.groupBy("word").agg(F.count("*").alias("n"))


def transitions(counts: DataFrame) -> dict[str, float]:
    """Log probability of each second character after the first, smoothed, over all words of the corpus.

    Only pairs of a-z are returned, as candidates have no other letters; pairs with other letters count in the totals.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    found = counts.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    plain = F.when(F.col("pair").rlike("^[a-z]{2}$"), F.struct("pair", "n"))
    first = found.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"), F.collect_list(plain).alias("pairs"))
    first = first.agg(F.count("*").alias("letters"), F.collect_list(F.when(F.size("pairs") > 0, F.struct("total", "pairs"))).alias("rows")).first()
    letters = max(1, first["letters"])
    return {p["pair"]: math.log((p["n"] + 0.5) / (r["total"] + 0.5 * letters)) for r in first["rows"] for p in r["pairs"]}


def _in_dictionary(found: DataFrame, common: DataFrame) -> DataFrame:
    """(row, covered, before_common, after_common): letters of the value in common words; whether its neighbours are common."""
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    entry = lambda kind: lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word"))
    runs = F.split(F.lower("value"), "[^a-z]+")
    asked = F.concat(F.transform(runs, entry(0)), F.array(entry(1)(letters(F.col("before"))), entry(2)(letters(F.col("after")))))
    asked = found.select("row", F.explode(asked).alias("e")).select("row", "e.*").where(F.length("word") >= 2)
    met = asked.join(common.select("word"), "word")
    of = lambda kind: (F.col("kind") == kind).cast("double")
    return met.groupBy("row").agg(F.sum(of(0) * F.length("word")).alias("covered"), F.max(of(1)).alias("before_common"), F.max(of(2)).alias("after_common"))


def features(found: DataFrame, common: DataFrame, table: dict[str, float]) -> DataFrame:
    """``found``, whose column row tells its rows apart, with a column for each of FEATURES."""
    pairs, logs = F.lit(list(table) or [""]), F.lit([float(x) for x in table.values()] or [0.0])
    value = F.col("value")
    size = F.greatest(F.length(value), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / size

    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substring(F.lower(value), i, F.lit(2)))
    usual = let(F.map_from_arrays(pairs, logs), lambda m: F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.coalesce(F.element_at(m, s), F.lit(-12.0)))) / size
    near = F.lower(F.concat_ws(" ", "before2", "before", "lead"))
    per_path = found.groupBy("path").agg(F.avg(F.col("value").rlike("^[0-9.]+$|@").cast("double")).alias("path_digits"), F.log1p(F.count("*")).alias("path_rate"))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out = found.withColumn("path", F.coalesce("path", F.lit(""))).join(per_path.withColumn("path", F.coalesce("path", F.lit(""))).dropDuplicates(["path"]), "path")
    out = out.join(_in_dictionary(found, common), "row", "left")
    return out.withColumns(
        {
            "size": size,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "others": share("[^A-Za-z0-9]"),
            "changes": F.length(shape) / size,
            "variety": F.array_size(F.array_distinct(F.split(value, ""))) / size,
            "hex": number(value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]")),
            "transitions": usual,
            "covered": number(F.col("covered")) / size,
            "path_rate": number(F.col("path_rate")),
            "path_digits": number(F.col("path_digits")),
            "keyword_near": number(near.rlike("|".join(KEYWORDS))),
            "assigned": number(F.concat("before", "lead").rlike("[=:]")),
            "quoted": number(F.col("lead").rlike("[\"']$")),
            "before_common": number(F.col("before_common")),
            "after_common": number(F.col("after_common")),
        }
    )


def seed_labels(found: DataFrame) -> DataFrame:
    """Labels where a format decides: 1 for keys of a known form and values assigned to a secret's name, 0 for mail, numbers and
    addresses, for which no name is given; null for all else."""
    value, near = F.col("value"), F.lower(F.concat_ws(" ", "before2", "before", "lead"))
    named = near.rlike(r"(password|passwd|pwd|secret|token|api[_-]?key)\W*[=:]\W*$")
    known = value.rlike(f"^({KNOWN})$")
    plain = value.rlike(r"^[0-9.\-/]+$|@|^\d+(\.\d+){3}$|\.(com|org|net|html?|php|txt)\b|^[a-z]+[0-9]{1,4}$")
    return found.withColumn("label", F.when(known | (named & ~plain), 1.0).when(plain & ~named, 0.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, least_count: int = COMMON) -> DataFrame:
    """One row per candidate: doc_id, path, word_at, value, score, is_secret (score of at least 0.5).

    ``docs`` needs doc_id, path and text. ``labelled`` (the columns of ``candidates`` and label) trains the forest; without it
    the candidates whose format decides are used, outside the fold where crc32 of the id modulo 3 is 1. If either label is
    missing nothing can be learnt: every candidate keeps score 1. Null texts have no candidates, a null path is the empty
    one, repeated rows give their candidates again, and no rows give none.
    """
    docs = docs.select("doc_id", "path", "text")
    found = written(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    counts = written(word_counts(docs), "words")
    common = counts.where(F.col("n") >= least_count)
    table = transitions(counts)
    train = labelled
    if train is None:
        train = seed_labels(found).where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True)))
    train = train.where("label is not null").orderBy(F.xxhash64("doc_id", "word_at", "value"), "doc_id", "word_at", "value").limit(sample)
    train = written(train.withColumn("row", F.monotonically_increasing_id()), "sampled")
    train = written(features(train, common, table).select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(1), "labelled")
    scored = features(found, common, table)
    if train.select("label").distinct().count() == 2:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(assembler.transform(train).select("features", "label"))
        scored = model.transform(assembler.transform(scored)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("score", F.lit(1.0))
    return scored.select("doc_id", "path", "word_at", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))
