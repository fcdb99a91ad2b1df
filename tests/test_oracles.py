"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from paperloom.plans import evidence, more, packages, packs, registry, review

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(x))
    if isinstance(x, float):
        return repr(float(x))
    return str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted([tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()], key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", ["tender_decision", "compliance_counts", "weighted_score", "vote_summary", "supplier_top5", "bulk_materials", "cost_by_currency", "quotation_score", "rate_limit", "latency_p95", "macro_f1", "accepted_candidates", "normalized_dedup", "repeated_lines", "section_ranges", "fact_conflicts", "words_vs_digits", "material_keys", "near_dup_pairs", "task_clusters", "tfidf_similar", "stream_hourly_counts", "stream_latest_stage", "stream_dedup_upsert", *review.QUERIES, "stream_sliding_limit", "stream_timeouts", "sliding_limit", "incremental_extraction", *more.ORACLE_SQL, *packs.ORACLE_SQL, *evidence.ORACLE_SQL, *packages.ORACLE_SQL])
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
