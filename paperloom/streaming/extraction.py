"""Incremental extraction of arriving files: a stream that reads each content once, and failures until they are known.

A folder holds what the stream has done, all of it append-only and by micro-batch: `manifest` (one line a file read, with
the digest of its content, the tools, what failed and how often in a row), `results` (what was extracted) and `snapshot`
(the manifest's last lines, compacted). A batch that is run again after a crash writes its own folder anew and looks at earlier
batches only, so it does what it did before. Results that others computed for a text, a model's say, lie in JSON-lines
files under the SHA-1 of the text; a line torn by a crash is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a file is read again until the same failure came so many times in a row.
FAILED_READS_BEFORE_REUSE = 2

MANIFEST = "filename string, digest string, tools string, failures array<string>, unsupported boolean, failed_reads int, reads int, batch long"
CACHE = "k string, v string, torn string"


def digest(content: Column) -> Column:
    return F.sha1(F.coalesce(content.cast("binary"), F.lit(b"")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What lies under path; no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def last_lines(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The manifest's last line of each file (filename, digest), as it stood before a micro-batch; at the end if none is given."""
    compact = _read(spark, f"{folder}/snapshot", MANIFEST.replace("batch long", "batch long, upto long"))
    lines = _read(spark, f"{folder}/manifest", MANIFEST)
    if before is not None:
        compact, lines = compact.where(F.col("upto") < before), lines.where(F.col("batch") < before)
    upto = compact.agg(F.max("upto")).first()[0]
    if upto is not None:
        lines = compact.where(F.col("upto") == upto).drop("upto").unionByName(lines.where(F.col("batch") > upto))
    one = lines.groupBy("filename", "digest").agg(F.max_by(F.struct(*lines.columns), "batch").alias("last"))
    return one.select("last.*")


def compact(spark: SparkSession, folder: str) -> None:
    """Write the manifest's last lines as one more snapshot; readers take the newest and the batches behind it."""
    lines = last_lines(spark, folder)
    upto = lines.agg(F.max("batch")).first()[0]
    if upto is not None:
        lines.withColumn("upto", F.lit(upto).cast("long")).write.mode("overwrite").parquet(f"{folder}/snapshot/snapshot-{upto}")


def to_read(files: DataFrame, known: DataFrame, tools: str) -> DataFrame:
    """files (filename, digest, ...) that must be read, with what is known of them in last (null: nothing).

    Known ones are left out, but for those with a failure or an unsupported part: they are read again if the tools
    changed, and those with a failure also until it came FAILED_READS_BEFORE_REUSE times in a row.
    """
    last = known.select("filename", "digest", F.struct("tools", "failures", "unsupported", "failed_reads", "reads").alias("last"))
    failed = F.size("last.failures") > 0
    short = (failed | F.col("last.unsupported")) & (F.col("last.tools") != tools)
    again = F.col("last").isNull() | short | (failed & (F.col("last.failed_reads") < FAILED_READS_BEFORE_REUSE))
    return files.join(last, ["filename", "digest"], "left").where(again)


def extract_files(files: DataFrame, folder: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], tools: str, compact_every: int = 20):
    """A DataStreamWriter over files (filename, content), a stream: start() it with the trigger that suits.

    extract maps rows (filename, digest, content, ...) to (filename, digest, result, failures: array of strings, unsupported: boolean),
    one row each. Of the same file and content twice in a micro-batch one is read. A null content is empty.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("digest", digest(F.col("content"))).dropDuplicates(["filename", "digest"])
        due = to_read(new, last_lines(spark, folder, number), tools)
        extract(due.drop("last")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/results/batch-{number}")
        found = spark.read.parquet(f"{folder}/results/batch-{number}")  # so that extract runs once
        known = due.select("filename", "digest", "last")
        same = F.coalesce((F.col("last.tools") == tools) & (F.col("last.failures") == F.col("failures")), F.lit(False))
        reads = F.when(F.size("failures") > 0, 1 + F.when(same, F.col("last.failed_reads")).otherwise(0)).otherwise(0)
        lines = found.join(known, ["filename", "digest"]).select(
            "filename", "digest", F.lit(tools).alias("tools"), "failures", "unsupported", reads.cast("int").alias("failed_reads"), (1 + F.coalesce("last.reads", F.lit(0))).cast("int").alias("reads"), "batch"
        )
        lines.write.mode("overwrite").parquet(f"{folder}/manifest/batch-{number}")
        if number % compact_every == compact_every - 1:
            compact(spark, folder)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def latest_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last result of each file; schema: of result. Columns filename, digest, result, failures, unsupported, batch."""
    rows = _read(spark, f"{folder}/results", f"filename string, digest string, result {schema}, failures array<string>, unsupported boolean, batch long")
    done = last_lines(spark, folder).select("filename", "digest", "batch")  # a batch that was cut off has results, but no lines yet
    return rows.join(done, ["filename", "digest", "batch"], "left_semi")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(k, v) of JSON lines {"k": SHA-1 of the text, "v": result} under path; of several lines of one key the last, by file and place. Torn lines are left out."""
    rows = spark.read.schema(CACHE).option("columnNameOfCorruptRecord", "torn").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    rows = rows.select("k", "v", place.alias("place"), F.col("torn").isNull().alias("whole"))
    return rows.where(F.col("whole") & F.col("k").isNotNull() & F.col("v").isNotNull()).groupBy("k").agg(F.max_by("v", "place").alias("v"))


def with_cached(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (text, ...) whose result is in cache (k, v), with it in v; and those that are not."""
    keyed = texts.withColumn("k", digest(F.col("text")))
    return keyed.join(cache, "k"), keyed.join(cache, "k", "left_anti")


def append_cache(results: DataFrame, path: str) -> None:
    """Append results (k, v) to the cache, as new files."""
    results.select("k", F.col("v").cast("string").alias("v")).write.mode("append").json(path)
