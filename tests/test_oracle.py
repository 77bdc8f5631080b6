"""Registered queries against their oracles on the smallest tables.

One query of each kind by default; PALIMPSEST_ALL=1 runs every query (about eight minutes).
``python tests/check_queries.py`` does the same at sf0.01 from the command line.
"""

import os

import pytest
from check_queries import compare, connect

import palimpsest.catalog.all  # noqa: F401
from palimpsest.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


CORE = (
    "scan_messages sink_messages persist_plan client_delta last_k_turns group_stamps budget_pack split_sentences concat_roles simhash64 slide_chunks slide_chunks_blocks chunk_run "
    "dedupe_near vector_topk select_hits unpack_transcript alias_search khop_expand bridge_nodes render_pack intent_label entities_v0 det_coerce link_entities kg_build "
    "memory_pack_batch sync_nodes sync_edges import_nodes import_aliases import_edges_merge alias_backfill task_upsert task_finish task_digest facts_apply fence_extract interest_extract ics_events "
    "events_to_tasks rrule_next remote_reconcile stream_chunks stream_kg stream_near_dup actions_apply"
).split()
WITHOUT: set[str] = set()
NAMES = sorted(set(QUERIES) - WITHOUT) if os.environ.get("PALIMPSEST_ALL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert name in ORACLES, "held against replayed cases in test_tasks.py and test_limits.py only"
    ok, info = compare(spark, duck, name, SF)  # an empty oracle is a failure
    assert ok, info


def test_oracles_belong_to_queries():
    assert set(QUERIES) - set(ORACLES) == WITHOUT and set(ORACLES) <= set(QUERIES)
