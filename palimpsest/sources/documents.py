"""JSON, NDJSON and calendar documents: readers give one row per text, parsers one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASK = "struct<name:string,importance:string,tags:array<string>,time:struct<date:string,start:string,end:string>,updates:array<string>>"
NODE = "struct<id:string,type:string,title:string,attrs_json:map<string,string>,confidence:double>"
EDGE = "struct<id:string,src_id:string,dst_id:string,type:string,weight:double,attrs_json:map<string,string>>"
NODE_LINE = ("nid string, labels array<string>, title string, "
             "props struct<name:string,id:string,aliases:array<string>,aka:array<string>,synonyms:array<string>>")
EDGE_LINE = "rid string, type string, src string, dst string, weight double, attrs map<string,string>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, text). For documents that fit a row; line files go through ``read_lines``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with ``line_no``, which rises along each file, and from file to file by path."""
    rows = spark.read.text(path)
    # ids rise along a split; splits follow each other by file and start
    return rows.select(F.col("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("line_no"))


def _clean(col: str):
    return F.regexp_replace(F.col(col), "^(﻿)?\\s+|^﻿", "")


def scan_tasks_json(docs: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Tasks of ``{"tasks": […]}`` documents; a bare array and a byte-order mark are tolerated, bad JSON yields none."""
    t = _clean(col)
    body = F.when(t.startswith("["), t).otherwise(F.get_json_object(t, "$.tasks"))
    rows = docs.select(key, F.posexplode(F.from_json(body, f"array<{TASK}>")).alias("pos", "t")).where("t IS NOT NULL")
    z = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        key, "pos", F.coalesce("t.name", F.lit("")).alias("name"), "t.importance", "t.tags", F.col("t.time.date").alias("date"), z("t.time.start").alias("start"),
        z("t.time.end").alias("end"), F.array_distinct(F.coalesce("t.updates", F.array().cast("array<string>"))).alias("updates"),
    )


def scan_facts_json(docs: DataFrame, key: str, col: str = "text", default_key: str = "General") -> DataFrame:
    """Facts of ``{"categories": {key: […]}}`` documents; flat ``{"entries": […]}`` go under the default key."""
    t = _clean(col)
    cats = F.from_json(F.get_json_object(t, "$.categories"), "map<string,array<string>>")
    flat = F.create_map(F.lit(default_key), F.from_json(F.get_json_object(t, "$.entries"), "array<string>"))
    rows = docs.select(key, F.explode(F.coalesce(cats, flat)).alias("key", "facts"))
    return rows.select(key, "key", F.posexplode("facts").alias("pos", "fact")).where(F.trim("fact") != "")


def scan_graph_json(docs: DataFrame, kind: str, col: str = "text") -> DataFrame:
    """``graph_nodes`` or ``graph_edges`` records; ``aliases`` of a node's attributes come out as a list."""
    schema = {"graph_nodes": NODE, "graph_edges": EDGE}[kind]
    rows = docs.select(F.explode(F.from_json(F.get_json_object(_clean(col), f"$.{kind}"), f"array<{schema}>")).alias("r")).select("r.*").where("id IS NOT NULL")
    if kind == "graph_nodes":
        rows = rows.withColumn("aliases", F.from_json(F.try_element_at("attrs_json", F.lit("aliases")), "array<string>"))
    return rows


def scan_graph_ndjson(lines: DataFrame, kind: str, col: str = "line") -> DataFrame:
    """Node or relation lines; blank, broken and key-less lines are skipped. The order of lines, ``line_no``, is kept if given."""
    schema = {"nodes": NODE_LINE, "relations": EDGE_LINE}[kind]
    kept = [c for c in lines.columns if c == "line_no"]
    # exploded, a line is parsed once: a filter on plain fields would move below and parse it again for each of them
    rows = lines.select(F.explode(F.array(F.from_json(col, schema))).alias("r"), *kept).select("r.*", *kept)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.where(has("nid")) if kind == "nodes" else rows.where(has("rid") & has("src") & has("dst"))


def read_graph_ndjson(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """NDJSON files straight from disk, split by line across tasks."""
    return scan_graph_ndjson(read_lines(spark, path), kind)
