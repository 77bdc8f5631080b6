"""Loading graphs: JSON sync, NDJSON import, alias backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.functions import text as X
from palimpsest.operators.merge import upsert
from palimpsest.operators.ordered import top_per_key

# --- fixed values -----------------------------------------------------------------------------------------
IMPORT_TYPES = ["Person", "Project", "Task", "Preference", "Artifact", "Time", "Quantity", "Company", "Product", "Animal", "AI", "Agent", "Speaker",
                "Event", "Topic", "Concept", "Meeting", "Course", "Other"]
ENTITY_MARKS = ["__Entity__", "Entity"]
IMPORT_CONFIDENCE, IMPORT_STATUS, IMPORT_WEIGHT, IMPORT_RELATION = 0.7, "promoted", 0.7, "related_to"
SYNC_SOURCE, SYNC_WEIGHT = "json_sync", 0.5
# -----------------------------------------------------------------------------------------------------------


def _strongest(rows: DataFrame, keys: list[str], strength: str, order: str, fields: list[str]) -> DataFrame:
    """Per key the row that in-order "replace if at least as strong" ends with: the last of the strongest."""
    best = F.max_by(F.struct(*fields), F.struct(strength, order)).alias("_n")
    return rows.groupBy(*keys).agg(best)


def sync_nodes(stored: DataFrame, incoming: DataFrame, order: str = "id") -> DataFrame:
    """Nodes after a sync: new ones provisional, known ones overwritten when at least as confident.

    ``incoming``: (id, type, title, attrs_json text, confidence). ``action``: inserted, updated, skipped or kept.
    """
    inc = incoming.withColumn("_ord", F.col(order)).withColumn("id", H.normalize_id("id", "n_"))
    fields = ["type", "title", "attrs_json", "confidence"]
    new = _strongest(inc, ["id"], "confidence", "_ord", fields)
    old = stored.select("id", F.struct(*fields, "status").alias("_o"))
    both = old.join(new, "id", "full_outer")
    wins = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.col("_n.confidence") >= F.col("_o.confidence")))
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").when(wins, "updated").otherwise("skipped")
    pick = lambda c: F.when(wins, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c)
    return both.select("id", *[pick(c) for c in fields], F.coalesce("_o.status", F.lit("provisional")).alias("status"), action.alias("action"))


def sync_aliases(stored: DataFrame, incoming: DataFrame, source: str = SYNC_SOURCE) -> DataFrame:
    """Alias rows to add: listed aliases whose (node, alias, source) is new. ``incoming``: (id, confidence, aliases)."""
    rows = incoming.select(H.normalize_id("id", "n_").alias("node_id"), F.coalesce("confidence", F.lit(1.0)).alias("weight"), F.posexplode("aliases").alias("pos", "alias"))
    rows = rows.withColumn("alias_key", X.alias_key("alias"))
    known = stored.where(F.col("source") == source).select("node_id", X.alias_key("alias").alias("alias_key")).distinct()
    first = rows.join(known, ["node_id", "alias_key"], "left_anti").groupBy("node_id", "alias_key").agg(F.min(F.struct("pos", "alias", "weight")).alias("f"))
    return first.select(H.alias_id("node_id", F.col("f.alias")).alias("id"), "node_id", F.col("f.alias").alias("alias"), F.lit(source).alias("source"), F.col("f.weight").alias("weight"))


def sync_edges(stored: DataFrame, nodes: DataFrame, incoming: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(edges, errors): insert, or overwrite weight and attributes when at least as heavy; ends must exist."""
    inc = incoming.select(
        F.col(order).alias("_ord"), H.normalize_id("id", "e_").alias("id"), H.normalize_id("src_id", "n_").alias("src_id"), H.normalize_id("dst_id", "n_").alias("dst_id"),
        "type", F.coalesce("weight", F.lit(SYNC_WEIGHT)).alias("weight"), "attrs_json",
    )
    ids = nodes.select("id")
    ok = inc.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    errors = inc.join(ok.select("id").distinct(), "id", "left_anti").select("id", "src_id", "dst_id")
    keys = ["src_id", "dst_id", "type"]
    first = ok.groupBy(*keys).agg(F.min_by("id", "_ord").alias("_first_id"))
    new = _strongest(ok, keys, "weight", "_ord", ["weight", "attrs_json"]).join(first, keys)
    old = stored.select(*keys, F.struct("id", "weight", "attrs_json").alias("_o"))
    both = old.join(new, keys, "full_outer")
    wins = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.col("_n.weight") >= F.col("_o.weight")))
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").when(wins, "updated").otherwise("skipped")
    pick = lambda c: F.when(wins, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c)
    return both.select(F.coalesce("_o.id", "_first_id").alias("id"), *keys, pick("weight"), pick("attrs_json"), action.alias("action")), errors


def sync_stats(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(what, action, n) over the results of a sync."""
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("what"), "action")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("what", "action").agg(F.count(F.lit(1)).alias("n"))


def import_type(labels) -> Column:
    """First label that is no entity mark, if it is a known type, else Other."""
    first = F.get(F.filter(labels, lambda x: ~x.isin(ENTITY_MARKS)), 0)
    return F.when(first.isin(IMPORT_TYPES), first).otherwise("Other")


def import_nodes(lines: DataFrame) -> DataFrame:
    """Node lines as node rows, with their candidate aliases and ``line_no``, the order in which they stand."""
    z = lambda c: F.nullif(F.col(c), F.lit(""))
    tail = F.concat(F.coalesce(F.get("labels", 0), F.lit("Entity")), F.lit("#"), F.right("nid", F.lit(6)))
    title = F.coalesce(z("title"), z("props.name"), z("props.id"), tail)
    none = F.array().cast("array<string>")
    listed = F.concat(F.coalesce("props.aliases", none), F.coalesce("props.aka", none), F.coalesce("props.synonyms", none),
                      F.when(F.col("props.id").isNotNull(), F.array("props.id")).otherwise(none), F.array(title))
    return lines.select(
        H.import_id("n_", "nid").alias("id"), import_type(F.coalesce("labels", none)).alias("type"), F.substring(title, 1, 255).alias("title"),
        F.lit(IMPORT_CONFIDENCE).alias("confidence"), F.lit(IMPORT_STATUS).alias("status"), listed.alias("aliases"), "line_no",
    )


def import_nodes_merge(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Upsert of imported nodes: the last line of a node wins; the type of a stored node stays."""
    return upsert(stored.select("id", "type", "title", "confidence", "status"), imported.select("id", "type", "title", "confidence", "status", "line_no"), ["id"], ["line_no"], keep=["type"])


def import_aliases(imported: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Aliases of imported nodes, unique by case: the last spelling at the first position; known ids are skipped.

    Several lines of a node count in the order of the lines.
    """
    rows = imported.select(F.col("id").alias("node_id"), "line_no", F.posexplode("aliases").alias("pos", "a")).withColumn("a", X.trim_ws("a")).where("a <> ''")
    place = F.struct("line_no", "pos")
    rows = rows.groupBy("node_id", F.lower("a").alias("_k")).agg(F.max_by("a", place).alias("alias"), F.min(place)["pos"].alias("pos"))
    out = rows.select(
        H.import_id("a_", F.concat_ws("|", "node_id", F.lower("alias"))).alias("id"), "node_id", F.substring("alias", 1, 255).alias("alias"), F.lit("import").alias("source"),
        F.lit(1.0).alias("weight"), "pos",
    )
    return out.join(stored.select("id"), "id", "left_anti") if stored is not None else out


def import_edges(lines: DataFrame) -> DataFrame:
    """Relation lines as edge rows keyed by their ends and type; the heaviest-known default weight fills gaps."""
    src, dst = H.import_id("n_", "src"), H.import_id("n_", "dst")
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit(IMPORT_RELATION))
    return lines.select(
        H.import_id("e_", F.concat_ws("|", src, kind, dst)).alias("id"), src.alias("src_id"), dst.alias("dst_id"), kind.alias("type"),
        F.coalesce("weight", F.lit(IMPORT_WEIGHT)).alias("weight"), F.to_json("attrs").alias("attrs_json"), F.col("rid"), F.col("line_no"),
    )


def import_edges_merge(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Upsert of imported edges on (src_id, dst_id, type): the last line wins, a stored edge keeps its id."""
    cols = ["id", "src_id", "dst_id", "type", "weight", "attrs_json"]
    return upsert(stored.select(*cols), imported.select(*cols, "line_no"), ["src_id", "dst_id", "type"], ["line_no"], keep=["id"])


def import_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imported edges with an end that is no node."""
    ends = edges.select("id", F.explode(F.array("src_id", "dst_id")).alias("end"))  # the edges are read and parsed once
    return ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct()


def relation_profile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("weighted"))


def alias_candidates(nodes: DataFrame, aliases: DataFrame, limit: int | None = None, only_missing: bool = True, source: str = "assistant") -> DataFrame:
    """Nodes to name: not tasks, without aliases of the source, oldest first."""
    rows = nodes.where("type <> 'Task'")
    if only_missing:
        done = aliases.where(F.col("source") == source).select(F.col("node_id").alias("id")).distinct()
        rows = rows.join(done, "id", "left_anti")
    return rows.orderBy("created_ts", "id").limit(limit) if limit else rows


def alias_backfill(candidates: DataFrame, nodes: DataFrame, aliases: DataFrame, source: str = "assistant") -> DataFrame:
    """Candidate aliases (node_id, pos, alias) that say something new about their node, with a weight by length."""
    c = candidates.withColumn("norm", X.alias_norm("alias")).where("norm <> ''")
    known = nodes.select(F.col("id").alias("node_id"), X.alias_norm("title").alias("norm")).unionByName(aliases.select("node_id", X.alias_norm("alias").alias("norm"))).distinct()
    fresh = top_per_key(c.join(known, ["node_id", "norm"], "left_anti"), ["node_id", "norm"], ["pos"], 1)
    weight = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(1.5) - F.lit(0.01) * F.length("alias")))
    return fresh.select(H.det_id("a_", "node_id", "norm").alias("id"), "node_id", "alias", F.lit(source).alias("source"), weight.alias("weight"))
