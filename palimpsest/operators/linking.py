"""Entity linking and edge creation, for whole batches at once.

Semantics of a batch: every entity is resolved against the aliases known before the batch (exact, then search).
What stays unresolved is grouped by its comparison key; each key becomes one provisional node. Later entities of
the batch therefore match a new node by its exact key, not by substring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.hashing import det_id
from palimpsest.operators.graph import alias_best, alias_exact
from palimpsest.session import checkpointed


def evidence_span(span) -> F.Column:
    """A two-number span as JSON, else null."""
    c = F.col(span) if isinstance(span, str) else span
    return F.when((F.size(c) == 2) & ~F.exists(c, lambda x: x.isNull()), F.to_json(F.struct(c.alias("span"))))


def link_entities(entities: DataFrame, aliases: DataFrame, source: str = "span") -> dict[str, DataFrame]:
    """Resolve entity rows (session_id, msg_id, pos, type, norm, text, span) to nodes.

    Returns ``links`` (entity rows with node_id and how), and the rows to append: ``nodes``, ``aliases``, ``evidence``.
    """
    raw = X.trim_ws(F.coalesce("norm", "text", F.lit("")))
    rows = checkpointed(entities.withColumn("term", raw).where("term <> ''"))
    hits = alias_best(rows.select("term"), aliases).select("term", "node_id", "how")
    known = rows.join(hits, "term", "left")
    fresh_id = det_id("n_", X.alias_key("term"))
    links = known.withColumn("how", F.coalesce("how", F.lit("created"))).withColumn("node_id", F.coalesce("node_id", fresh_id))
    links = checkpointed(links)
    made = links.where("how = 'created'")
    first = F.min_by(F.struct("type", "term"), F.struct("msg_id", "pos")).alias("f")
    new_nodes = made.groupBy("node_id").agg(first).select(
        F.col("node_id").alias("id"), F.coalesce("f.type", F.lit("Other")).alias("type"), X.normalize_title(F.col("f.term")).alias("title"),
        F.lit(0.3).alias("confidence"), F.lit("provisional").alias("status"), F.col("f.term").alias("_alias"),
    )
    new_aliases = new_nodes.select(
        det_id("a_", "id", "_alias").alias("id"), F.col("id").alias("node_id"), F.col("_alias").alias("alias"), F.lit(source).alias("source"),
        F.lit(1.0).alias("weight"), X.alias_key("_alias").alias("alias_key"),
    )
    evidence = links.select(
        det_id("v_", "node_id", F.col("msg_id").cast("string"), F.col("pos").cast("string")).alias("id"), F.lit("node").alias("subject_kind"),
        F.col("node_id").alias("subject_id"), "msg_id", evidence_span("span").alias("span_json"),
    )
    return {"links": links, "nodes": new_nodes.drop("_alias"), "aliases": new_aliases, "evidence": evidence}


def link_report(links: DataFrame) -> DataFrame:
    """Seeds, created and matched per message; of the rows sharing a new node the first counts as created."""
    first = links.where("how = 'created'").groupBy("node_id").agg(F.min(F.struct("msg_id", "pos")).alias("f"))
    rows = links.join(first, "node_id", "left").withColumn("made", F.coalesce(F.struct("msg_id", "pos") == F.col("f"), F.lit(False)))
    return rows.groupBy("msg_id").agg(F.count_distinct("node_id").alias("seeds"), F.count_if("made").alias("created"), F.count_if(~F.col("made")).alias("matched"))


def create_edges(entities: DataFrame, slots: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of each message: Task -deadline-> Time when the slot names that time, Task -task_in_project-> Project.

    ``entities``: (msg_id, pos, type, norm, attrs); ``slots``: (msg_id, deadline). Names resolve by exact alias.
    """
    rows = entities.where(F.col("norm") != "")
    named = alias_exact(rows.select(F.col("norm").alias("term")), aliases).select(F.col("term").alias("norm"), "node_id")
    rows = rows.join(named, "norm")
    tasks = rows.where("type = 'Task'").select("msg_id", F.col("node_id").alias("src_id"))
    times = rows.where("type = 'Time'").select("msg_id", "pos", F.col("attrs")["iso"].alias("iso"), "node_id").where("iso IS NOT NULL")
    times = times.groupBy("msg_id", "iso").agg(F.max_by("node_id", "pos").alias("dst_id"))
    due = slots.where("deadline IS NOT NULL").join(times, F.expr("deadline = iso") & (slots["msg_id"] == times["msg_id"])).select(slots["msg_id"], "dst_id", "iso")
    deadline = tasks.join(due, "msg_id").select("msg_id", "src_id", "dst_id", F.lit("deadline").alias("type"), F.to_json(F.struct("iso")).alias("attrs_json"))
    projects = rows.where("type = 'Project'").select("msg_id", F.col("node_id").alias("dst_id"))
    member = tasks.join(projects, "msg_id").select("msg_id", "src_id", "dst_id", F.lit("task_in_project").alias("type"), F.lit(None).cast("string").alias("attrs_json"))
    return deadline.unionByName(member).withColumn("weight", F.lit(0.5)).withColumn("id", det_id("e_", "src_id", "dst_id", "type"))


def edge_evidence(edges: DataFrame) -> DataFrame:
    return edges.select(
        det_id("v_", "id", F.col("msg_id").cast("string")).alias("id"), F.lit("edge").alias("subject_kind"), F.col("id").alias("subject_id"), "msg_id",
        F.lit(None).cast("string").alias("span_json"),
    ).dropDuplicates(["id"])


def turn_pairs(msgs: DataFrame) -> DataFrame:
    """Each user row with the next user or assistant row of its session when that is an answer."""
    from palimpsest.operators.ordered import cell_scan, id_cell

    rows = msgs.where(F.col("role").isin("user", "assistant")).withColumn("_neg", -F.col("id"))
    # the next row by id is the previous row by -id
    nxt = cell_scan(rows, ["session_id"], ["_neg"], id_cell("_neg"), lags={"_n": F.struct("id", "role", "ts")})
    answer = F.when(F.col("_n.role") == "assistant", F.col("_n"))
    return nxt.where("role = 'user'").select(
        "session_id", F.col("id").alias("user_msg_id"), answer["id"].alias("assistant_msg_id"), F.col("ts").alias("ts_user"), answer["ts"].alias("ts_assistant"), "content"
    )
