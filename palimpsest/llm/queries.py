"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import collocations, decontaminate, fingerprints, graphsearch, hardnegatives, langid, linededup, neardedup, packing, perspectives, quality, secrets, sharding
from palimpsest.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").withColumnRenamed("source", "path"))


@query(
    "op3_decontaminate",
    f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN items USING (win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(
    "op4_perspectives",
    r"""
WITH t AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text, CAST(floor(turn / 64) AS BIGINT) AS part
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
s AS (SELECT conv_id, speaker, part, turn, who, text,
    '<|im_start|>' || CASE WHEN who = 'system' THEN who WHEN who = speaker THEN 'assistant' ELSE 'user name=' || regexp_replace(translate(who, chr(13) || chr(10), '  '), '<(\\*)\|', '<\1\\|', 'g') END || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS body FROM t JOIN p USING (conv_id)),
o AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, who, text) AS BIGINT) AS till FROM s)
SELECT conv_id, speaker, part, count(*) AS n_turns, max(till) AS n_chars,
  CAST(coalesce(sum(length(body)) FILTER (WHERE who = speaker), 0) AS BIGINT) AS n_masked,
  sha256(string_agg(head || body, '' ORDER BY turn, who, text)) AS text_sha256,
  coalesce(string_agg((till - length(body)) || '-' || till, ',' ORDER BY turn, who, text) FILTER (WHERE who = speaker), '') AS spans
FROM o GROUP BY conv_id, speaker, part""",
)
def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "speaker", "part", "n_turns", "n_chars", "n_masked", F.sha2("text", 256).alias("text_sha256"), spans.alias("spans"))


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), **linededup.WHOLE)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_file())


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op11_hard_negatives",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return hardnegatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 100 == 0)


@query("op13_neighbours")
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return graphsearch.neighbours(rows, F.col("vec_id") % 50 == 0)


@query(
    "op12_collocations",
    r"""
WITH p AS (SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
f AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS n FROM s JOIN (SELECT unnest(range(1, 5)) AS k) ON s + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 30),
covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(n) AS most
  FROM (SELECT lang, k, w, n, m, unnest(range(1, k - m + 2)) AS i FROM c JOIN (SELECT unnest([2, 3]) AS m) ON m < k) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN covers USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(c.n AS HUGEINT)),
cuts AS (SELECT lang, phrase, n AS a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, i, x.n AS l, y.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.n + y.n) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER t AS rank, phrase, a, l, r, n.n, score FROM least JOIN n USING (lang)
WINDOW t AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER t <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
