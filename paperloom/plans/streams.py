"""Streaming queries, run over the finished input, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.sources.tables import table
from paperloom.streaming import events as S
from paperloom.streaming import extraction

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stream(spark, sf):
    return S.event_stream(spark, sf, "events.parquet")


@query("SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS events FROM events GROUP BY 1")
def stream_latest_stage(spark, sf):
    none = spark.createDataFrame([], "job long, stage string, at timestamp, event_id long, events long")
    return S.finished_merge(_stream(spark, sf), none, S.merge_stages).select("job", "stage", "events")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) GROUP BY 1, 2")
def stream_hourly_counts(spark, sf):
    """Hours that the watermark has passed; later ones are still open."""
    rows = S.finished(S.hourly_counts(_stream(spark, sf)))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup_upsert(spark, sf):
    current = table(spark, sf, "events").where("event_id % 2 = 0").select("event_id", "user_id", F.lit("old").alias("event_type"))
    return S.finished_merge(S.distinct_arrivals(_stream(spark, sf)), current, lambda old, new: S.upsert(old, new.select("event_id", "user_id", "event_type"), "event_id"))


@query("SELECT user_id AS job, date_trunc('millisecond', max(ts)) AS last, count(*) AS events FROM events WHERE event_type = 'error' GROUP BY 1 HAVING date_trunc('millisecond', max(ts)) + INTERVAL 180 SECOND < (SELECT max(date_trunc('millisecond', ts)) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE")
def stream_timeouts(spark, sf):
    rows = S.finished(S.dead_jobs(_stream(spark, sf)))
    return rows.withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, ts, failures FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error') WHERE failures >= 2")
def stream_sliding_limit(spark, sf):
    rows = S.finished(S.sliding_limit(_stream(spark, sf), seconds=86_400, most=2))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, ts, failures FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error') WHERE failures >= 2")
def sliding_limit(spark, sf):
    return S.sliding_limit(table(spark, sf, "events"), seconds=86_400, most=2)


def read_pages(files):
    """Sentences and characters of each content; a line of 20 characters or more that is not half letters cannot be read."""
    content = F.coalesce("content", F.lit(""))
    lines = F.transform(F.split(content, "\n"), lambda line, n: F.when((F.length(line) >= 20) & (2 * F.length(F.regexp_replace(line, r"[^\p{L}]", "")) < F.length(line)), F.concat(F.lit("line "), n)))
    result = F.struct(F.size(T.sentences(content)).alias("sentences"), F.length(content).alias("chars"))
    return files.select("filename", "digest", result.alias("result"), F.array_compact(lines).alias("failures"), F.col("content").isNull().alias("unsupported"))


@query(r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS unsupported, string_split(coalesce(text, ''), chr(10)) AS lines, CASE WHEN doc_id % 6 = 0 THEN 3 ELSE 1 END AS arrivals FROM documents),
g AS (SELECT *, list_filter(list_transform(lines, lambda l, i: CASE WHEN length(l) >= 20 AND 2 * length(regexp_replace(l, '[^\p{L}]', '', 'g')) < length(l) THEN concat('line ', i - 1) END), lambda x: x IS NOT NULL) AS failures FROM f)
SELECT concat('document ', doc_id) AS filename, sha1(t) AS digest, len(list_filter(flatten(list_transform(lines, lambda l: string_split(regexp_replace(l, '([.;?!])\s+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: trim(s) <> '')) AS sentences, length(t) AS chars,
  array_to_string(failures, ', ') AS failures, unsupported, CASE WHEN len(failures) > 0 THEN least(arrivals, 2) ELSE 0 END AS failed_reads, CASE WHEN len(failures) > 0 THEN least(arrivals, 2) ELSE 1 END AS reads FROM g""")
def incremental_extraction(spark, sf):
    """All documents arrive in three parts, those whose id 6 divides in every one; after each part the stream stops and is started again."""
    folder, kind = S.shared_folder(spark), "struct<sentences:int,chars:int>"
    rows = table(spark, sf, "documents").select(F.concat(F.lit("document "), "doc_id").alias("filename"), F.col("text").alias("content"), "doc_id")
    for part in range(3):
        rows.where((F.col("doc_id") % 3 == part) | (F.col("doc_id") % 6 == 0)).drop("doc_id").write.mode("append").parquet(f"{folder}/feed")
        feed = spark.readStream.schema("filename string, content string").parquet(f"{folder}/feed")
        extraction.extract_files(feed, f"{folder}/done", f"{folder}/checkpoint", read_pages, "reader 1", 2).trigger(availableNow=True).start().awaitTermination()
    done = extraction.latest_results(spark, f"{folder}/done", kind)
    lines = extraction.last_lines(spark, f"{folder}/done").select("filename", "digest", "failed_reads", "reads")
    return done.join(lines, ["filename", "digest"]).select("filename", "digest", "result.*", F.array_join("failures", ", ").alias("failures"), "unsupported", "failed_reads", "reads")
