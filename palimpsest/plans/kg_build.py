"""Detections x messages -> links, nodes, aliases, evidence, edges, mark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rules as R
from palimpsest.functions import text as X
from palimpsest.operators import detection as D
from palimpsest.operators import linking as L
from palimpsest.session import checkpointed


def detection_rows(detections: DataFrame, col: str = "det_json") -> tuple[DataFrame, DataFrame]:
    """(entity rows, slot rows) of the valid detections, clamped to the allow-lists."""
    rows = detections.select("session_id", "msg_id", R.clean_detection(col).alias("det"))
    rows = checkpointed(rows).where("det IS NOT NULL")  # parsed once, read by linking and by edge creation
    ents = D.entity_rows(rows, F.col("det.entities"), ["session_id", "msg_id"])
    return ents, rows.select("msg_id", F.col("det.slots")["deadline"].alias("deadline"))


def kg_build(detections: DataFrame, aliases: DataFrame | Callable[[DataFrame], DataFrame], source: str = "span") -> dict[str, DataFrame]:
    """Everything one batch adds to the graph. Ids are hashes of content, so a repeated batch adds nothing new.

    ``aliases`` are those known before, or a function that gives those that matter for a table of terms (term). The mark
    covers every row of the batch, also those with an invalid detection.
    """
    ents, slots = detection_rows(detections)
    if callable(aliases):
        named = ents.select(F.explode(F.array(X.trim_ws(F.coalesce("norm", "text", F.lit(""))), F.coalesce("norm", F.lit("")))).alias("term"))
        aliases = checkpointed(aliases(named.where("term <> ''").distinct()))
    out = L.link_entities(ents, aliases, source)
    cols = ["id", "node_id", "alias", "source", "weight", "alias_key"]
    known = aliases.select(*cols).unionByName(out["aliases"].select(*cols))
    edges = L.create_edges(ents, slots, known)
    out["edges"] = edges.groupBy("src_id", "dst_id", "type").agg(F.max_by(F.struct("id", "weight", "attrs_json"), "msg_id").alias("e")).select("src_id", "dst_id", "type", "e.*")
    out["evidence"] = out["evidence"].unionByName(L.edge_evidence(edges))
    out["mark"] = detections.agg(F.max("msg_id").alias("last_id"))
    return out


def assistant_memory(msgs: DataFrame, aliases: DataFrame, catalog: list[dict] | None = None) -> dict[str, DataFrame]:
    """Assistant texts without action blocks, detected and linked under their own source."""
    rows = msgs.withColumn("clean", X.strip_fences("content")).where("clean <> ''")
    det = D.detect_texts(rows, "clean", catalog=catalog)
    ents = D.entity_rows(det.withColumnRenamed("id", "msg_id"), F.col("det.entities"), ["session_id", "msg_id"])
    ents = ents.withColumn("span", F.array("start", "end")).withColumn("attrs", F.create_map().cast("map<string,string>"))
    return L.link_entities(ents, aliases, "assistant")
