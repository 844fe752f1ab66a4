"""Registered queries against their SQL on the smallest tables (ALL_QUERIES=1 runs every one)."""

import os

import pytest
from compare import difference, oracle

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "canonicalize_links", "merge_exact_duplicates_saves", "recanonicalize_plan", "match_existing", "word_counts",
    "enrich_from_pages", "near_duplicate_in_batch", "language_gate", "qualify", "duplicate_pairs", "duplicate_groups",
    "merge_references_signals", "classify", "leading_topics", "rank_for_you", "rank_trending", "page_feed", "key_points",
    "topic_audit", "signals_fold", "signals_stream", "reader_state", "reader_state_stream", "verdict_log_stream",
    "quota_ledger", "event_windows", "normalize_rss", "normalize_stack_exchange", "extract_page_metadata", "clean_image_urls",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem, _ = difference(spark, con, FOLDER, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
