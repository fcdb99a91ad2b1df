"""The incremental extraction stream: retries, changed tools, crashes, compaction, the result cache."""

import glob
import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import extraction

calls = []


@pytest.fixture
def feed(spark, tmp_path):
    """add(rows) puts one file of (filename, content) into the feed and runs the stream to its end; state() gives the manifest by file."""

    def add(rows, tools="reader 1", compact_every=20, parts=1):
        if rows:
            spark.createDataFrame(rows, "filename string, content string").repartition(parts).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema("filename string, content string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
        query = extraction.extract_files(stream, f"{tmp_path}/done", f"{tmp_path}/checkpoint", reader, tools, compact_every)
        query.trigger(availableNow=True).start().awaitTermination()

    def state():
        return {r.filename: (r.reads, r.failed_reads, r.tools) for r in extraction.last_lines(spark, f"{tmp_path}/done").collect()}

    return add, state, tmp_path


def reader(files):
    bad = F.col("content").contains("?")
    failures = F.when(bad, F.array(F.regexp_extract("content", r"\?(\w*)", 1))).otherwise(F.array().cast("array<string>"))
    return files.select("filename", "digest", F.struct(F.length("content").alias("chars")).alias("result"), F.coalesce(failures, F.array().cast("array<string>")).alias("failures"), F.col("content").isNull().alias("unsupported"))


def test_failures_are_read_until_known(feed):
    add, state, _ = feed
    rows = [("good", "text"), ("bad", "te?xt"), ("scan", None)]
    for _ in range(4):
        add(rows)
    assert state() == {"good": (1, 0, "reader 1"), "bad": (2, 2, "reader 1"), "scan": (1, 0, "reader 1")}
    add(rows, tools="reader 2")
    assert state() == {"good": (1, 0, "reader 1"), "bad": (3, 1, "reader 2"), "scan": (2, 0, "reader 2")}
    add(rows, tools="reader 2")
    add(rows, tools="reader 2")
    assert state()["bad"] == (4, 2, "reader 2")


def test_new_content_is_a_new_file(spark, feed):
    add, _, folder = feed
    add([("a", "one"), ("a", "one"), ("b", "one")])
    add([("a", "two")])
    got = extraction.latest_results(spark, f"{folder}/done", "struct<chars:int>").select("filename", "digest").collect()
    want = {("a", "one"), ("b", "one"), ("a", "two")}
    assert sorted(map(tuple, got)) == sorted((f, hashlib.sha1(c.encode()).hexdigest()) for f, c in want)


def test_crash_between_results_and_manifest(spark, feed):
    """A batch whose manifest and commit are lost runs again, writes the same, and counts no read twice."""
    add, state, folder = feed
    add([("good", "text"), ("bad", "te?xt")])
    add([("bad", "te?xt"), ("new", "n")])
    before = state()
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{folder}/checkpoint/commits/[0-9]*"))
    shutil.rmtree(f"{folder}/done/manifest/batch-{last}")
    for path in (f"{folder}/checkpoint/commits/{last}", f"{folder}/checkpoint/commits/.{last}.crc"):
        os.remove(path)
    assert state() != before  # results without lines do not count
    add([])
    assert state() == before
    rows = extraction.latest_results(spark, f"{folder}/done", "struct<chars:int>").collect()
    assert sorted(r.filename for r in rows) == ["bad", "good", "new"]


def test_many_batches_and_compaction(spark, feed):
    add, state, folder = feed
    rows = [(f"f{i}", "x" * i + ("?" if i % 3 == 0 else "")) for i in range(12)]
    add(rows, compact_every=2, parts=4)
    add(rows, compact_every=2, parts=3)
    add(rows, compact_every=2)
    assert glob.glob(f"{folder}/done/snapshot/*")
    assert state() == {f"f{i}": ((2, 2) if i % 3 == 0 else (1, 0)) + ("reader 1",) for i in range(12)}
    lines = extraction.last_lines(spark, f"{folder}/done", before=3)
    assert lines.where("batch >= 3").count() == 0


def test_cache_skips_torn_lines(spark, tmp_path):
    key = lambda t: hashlib.sha1(t.encode()).hexdigest()
    (tmp_path / "cache").mkdir()
    lines = [json.dumps({"k": key("a"), "v": "old"}), json.dumps({"k": key("a"), "v": "new"}), json.dumps({"k": key("b"), "v": "b"}), json.dumps({"v": "no key"}), '{"k": "' + key("c") + '", "v": "to']
    (tmp_path / "cache" / "one.json").write_text("\n".join(lines))
    path = str(tmp_path / "cache")
    cache = extraction.cached(spark, path)
    assert {r.k: r.v for r in cache.collect()} == {key("a"): "new", key("b"): "b"}
    hit, miss = extraction.with_cached(spark.createDataFrame([("a",), ("c",), (None,)], "text string"), cache)
    assert [r.v for r in hit.collect()] == ["new"] and miss.count() == 2
    extraction.append_cache(miss.select("k", F.lit("later").alias("v")), path)
    assert extraction.with_cached(spark.createDataFrame([("c",)], "text string"), extraction.cached(spark, path))[0].count() == 1
