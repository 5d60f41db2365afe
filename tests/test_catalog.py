"""Every query against the SQL engine on the smallest tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from loglattice import catalog, oracle  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")

# written to and read back from stored tables; checked at the larger scale by tools/check_oracle.py
STORED = {
    "ingest_twice", "purge_store", "backfill_stored", "stream_ingest", "stream_journal", "backfill_after_purge", "safety_net_stored", "failed_batch_replay",
    "stored_search_logs", "stored_search_templates", "reembed_new_model", "stream_noise_stats", "stream_dedup_late", "stream_cooldown", "catalog_views",
    "merge_day_files", "stored_query_logs", "stored_retention_report",
}
NO_SQL = set()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(oracle.statements()) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - NO_SQL - STORED))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["template_id", "canonical_text", "event_count", "similarity_score", "rank", "event_id"]
    assert df.count() > 0
