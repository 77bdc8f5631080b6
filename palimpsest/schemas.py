"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "sessions": "id string, started_at timestamp, closed_at timestamp, title string, meta string",
    "messages": (
        "id bigint, session_id string, ts timestamp, role string, content string, model string, tokens_in int, tokens_out int, "
        "is_summary boolean, content_hash string, tool_call_id string, tool_calls_json string"
    ),
    "graph_nodes": "id string, type string, title string, attrs_json string, confidence double, status string, created_ts timestamp, updated_ts timestamp, emb_vec binary",
    "graph_node_aliases": "id string, node_id string, alias string, source string, weight double, created_ts timestamp, alias_key string",
    "graph_edges": "id string, src_id string, dst_id string, type string, weight double, attrs_json string, created_ts timestamp, updated_ts timestamp",
    "graph_evidence": "id string, subject_kind string, subject_id string, msg_id bigint, span_json string, created_ts timestamp",
    "graph_config_kv": "ns string, key string, value_json string, updated_ts timestamp",
    "graph_turns": (
        "id string, sid string, user_msg_id bigint, assistant_msg_id bigint, ts_user timestamp, ts_assistant timestamp, intent string, scores_json string, "
        "detections_json string, slots_json string, detector_version string, turn_version string, processed boolean"
    ),
    "graph_embeddings": "node_id string, dim smallint, dtype string, vec_blob binary, updated_ts timestamp",
    "processed_chunks": "last_message_ts timestamp, last_id bigint, processed_at timestamp",
    "tasks": "owner bigint, seq bigint, name string, importance string, tags array<string>, date string, start string, end string, updates array<string>",
    "facts": "owner bigint, key string, fact string, pos bigint",
    "chunks": (
        "id string, session_id string, chunk_ord bigint, start_iso string, start_ts timestamp, chunk_text string, hash string, sim bigint, simhash64 string, len int, source string"
    ),
}

ROLES = ["system", "user", "assistant", "tool"]
STATUSES = ["provisional", "promoted"]
SUBJECTS = ["node", "edge"]


def schema(name: str) -> T.StructType:
    """Schema of a stored table, for readers that should not infer one."""
    return T.StructType.fromDDL(SCHEMAS[name])
