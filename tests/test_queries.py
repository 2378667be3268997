"""Registered queries against their SQL on the smallest tables. ALL_QUERIES=1 runs every one."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import ROOT, compare, connection

SF = f"{ROOT}/sf0.001"
SOME = [
    "a12_duplicate_titles", "a16_centroids", "a27_edge_class_extremes", "d03_deduplicated_links", "d04_comma_links",
    "d07_store_report", "f24_words_and_pairs", "j01_papers_with_authors", "j05_clusters_needing_labels",
    "j12_find_or_create_authors", "j15_hierarchy_walk", "j19_knn_euclidean", "j21_positional_zip", "o07_report_orders",
    "p18_cluster_prompts", "s02_version_records", "s06_upsert_labels", "v04_quality_summary", "v07_relative_validity",
    "v14_cluster_keywords", "v19_network_nodes", "w04_rolling_usage", "w05_daily_count", "w07_token_packing",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, queries()[name], oracle_sql()[name], SF)
    assert ok, note


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["norm_title", "n_papers", "first_id"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
