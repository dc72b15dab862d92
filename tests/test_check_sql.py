"""Registered queries against their check SQL on the smallest tables.

A spread of quick queries by default; TRADEQ_ALL=1 runs every one.
"""

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "terminal_labels", "ambiguous_names", "target_priority", "urgent_prices", "terminal_staleness", "route_pairs",
    "effective_economics", "container_fit", "top_routes", "payload_issues", "duplicate_guard", "drift_findings",
    "asof_prices", "dropped_rows", "batch_summary", "wire_payloads", "submitted_sources", "pending_files",
    "terminal_search", "detected_tabs", "container_union", "region_lines", "retry_merge", "error_rates", "envelope_scan",
    "audit_append", "spaced_submissions", "streamed_guard", "streamed_quota", "streamed_overlay", "gated_batch", "settled_tabs",
    "merged_terminals", "unresolved_terminals", "wire_files", "bound_routes", "scoped_routes", "captured_files",
]
NAMES = list(queries()) if os.environ.get("TRADEQ_ALL") else QUICK

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_rows_agree(spark, con, name):
    status, _, _, note = compare(spark, con, name, FOLDER)
    assert status in ("ok", "rows-only"), note


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
