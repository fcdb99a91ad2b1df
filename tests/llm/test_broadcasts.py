"""Tables that Spark takes for small, as after an explode, are merged and not broadcast: the driver would have to hold them."""

import pytest
from pyspark.sql import functions as F

from paperloom.llm import _shared, mixing, simhash_dedup


@pytest.fixture
def no_small_table(spark):
    """Spark decides by the sizes that it estimates, as it does at the start of any query."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ends_of_the_buckets_are_not_broadcast(no_small_table, monkeypatch):
    plans, write = {}, simhash_dedup.shared_table

    def seen(df, label):
        plans.setdefault(label, plan_of(df))
        return write(df, label)

    monkeypatch.setattr(simhash_dedup, "shared_table", seen)
    fps = write(no_small_table.range(300).select(F.xxhash64("id").alias("fp")), "distinct")
    assert simhash_dedup.fingerprint_components(fps).count() == 300
    assert "Join" in plans["buckets"] and "Broadcast" not in plans["buckets"]


def test_lines_that_stay_are_not_broadcast(no_small_table):
    docs = no_small_table.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 40).alias("text"), F.lit("s").alias("source"))
    kept = _shared.keep_rows(docs, docs.where("doc_id % 2 = 0").select(_shared.line_digest(docs).alias("line")))
    assert kept.count() == 25
    assert "SortMergeJoin" in plan_of(kept) and "Broadcast" not in plan_of(kept)


def test_lines_that_are_mixed_are_not_broadcast(no_small_table, monkeypatch):
    docs = no_small_table.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 40).alias("text"), F.lit("s").alias("source"))
    taken = docs.select(_shared.line_digest(docs).alias("line"), F.lit(2).cast("long").alias("copies"))
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: taken)
    rows = mixing.mixed_documents(docs)
    assert rows.count() == 100
    assert "SortMergeJoin" in plan_of(rows) and "Broadcast" not in plan_of(rows)
