"""Exact deduplication with a split of heavy hitters.

A Misra-Gries pass (Spark's freqItems) finds every digest that may hold more than a given share of the
rows. Exact counts verify these candidates, and the winners, at most 1 / support of them, are broadcast:
their rows are settled on the map side. All other digests take the ordinary shuffle, where no group can
be larger than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, keep_rows, line_digest, shared_table

SUPPORT = 1 / 2000


def heavy_digests(digests: DataFrame, rows: int, support: float = SUPPORT) -> DataFrame:
    """(digest, best, group_size) of the digests with at least support of the rows; 1 / support rows at most."""
    candidates = digests.select("digest").stat.freqItems(["digest"], support)
    candidates = candidates.select(F.explode("digest_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest")
    counted = counted.agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    return counted.where((F.col("group_size") > 1) & (F.col("group_size") >= support * rows))


def _groups(docs: DataFrame, support: float, line: F.Column) -> DataFrame:
    """doc_id, digest, line, group_size, and best, the rank of the row that stays of its text; rank names each row of the table."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    digests = docs.select("doc_id", digest.alias("digest"), line.alias("line"), F.monotonically_increasing_id().alias("row"))
    digests = shared_table(digests, "digests").withColumn("rank", F.struct("doc_id", "line", -F.col("row")))
    heavy = heavy_digests(digests, digests.count(), support)
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    rest = marked.where("group_size is null").withColumn("best", F.max("rank").over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    return marked.where("group_size is not null").unionByName(rest)


def duplicate_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays, a null
    doc_id being smaller than any other (keep_id is null if a group has no other). Of repeated rows, alike
    in doc_id and text, one stays. No rows give no rows; other columns of docs are not read.
    """
    groups = _groups(docs, support, F.lit(""))
    return groups.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs without the rows that duplicate_groups drops; all columns. Of rows alike in doc_id and text that with the greatest line_digest stays."""
    kept = _groups(docs, support, line_digest(docs)).where(F.col("rank") == F.col("best"))
    return keep_rows(docs, kept.select("line"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


SQL = {
    "op9_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
