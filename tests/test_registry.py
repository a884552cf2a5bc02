"""Registered queries against their oracle, and streams against batch, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
QUICK = ["wf_hourly_recurrence", "sc1_discover_sources", "pf3_mixed_timestamps", "ag9_station_month_audit", "ev3_validity_flags", "jn2_asof_last_event",
         "jn3_range_counts", "wn7_risk_spells", "wn14_multistep_targets", "al4_paced_monthly_cap", "al6_latched_budget", "tk3_budget_threshold",
         "mt4_alarm_classes", "mx5_metrics_by_group", "bs4_paired_alarm_ratios", "sp6_purged_splits", "va6_prefix_invariance", "st2_streaming_episodes",
         "st6_late_rows_are_flagged", "st9_batch_stream_equality"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, oracle, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    assert len(got) and rows(got) == rows(oracle.execute(entry.oracle_sql()[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
