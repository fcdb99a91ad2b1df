"""The decision pack of each tender, a nested row, and snapshots of it that are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nested(rows: DataFrame, order: list, most: int) -> DataFrame:
    """tender_id, n, rows: how many rows a tender has, and the first most of them by order as an array of structs of the other columns."""
    columns = [c for c in rows.columns if c != "tender_id"]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("tender_id").orderBy(*order))).where(F.col("nth") <= most)
    held = first.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*columns).alias("row")))).alias("held"))
    return rows.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n")).join(held, "tender_id").select("tender_id", "n", F.transform("held", lambda x: x["row"]).alias("rows"))


def decision_pack(tenders: DataFrame, singles: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list, int]]) -> DataFrame:
    """One row for each of tenders (tender_id): a struct for each of singles, which have a row a tender at most, null if it has none; for each of lists (rows,
    order, most) a struct of n and the first rows. Everything is one row a tender before it is joined, so no join multiplies another."""
    pack = tenders.select("tender_id")
    for name, rows in singles.items():
        pack = pack.join(rows.select("tender_id", F.struct(*[c for c in rows.columns if c != "tender_id"]).alias(name)), "tender_id", "left")
    for name, (rows, order, most) in lists.items():
        pack = pack.join(nested(rows, order, most).select("tender_id", F.struct("n", "rows").alias(name)), "tender_id", "left")
    return pack


def append_snapshot(pack: DataFrame, path: str, run: int, version: str) -> None:
    """Write pack (tender_id, ...) as the snapshot of run, with its version; a run that is there already is an error."""
    pack.withColumn("analysis_version", F.lit(version)).write.mode("error").parquet(f"{path}/run={run}")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots, with run; columns and fields that older ones lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn("run", F.col("run").cast("long"))


def latest(spark: SparkSession, path: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The last snapshot of each tender; defaults stand in for columns that it does not have."""
    rows = snapshots(spark, path)
    last = rows.groupBy("tender_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "tender_id"]), "run").alias("last")).select("tender_id", "last.*")
    return last.withColumns({c: F.coalesce(c, value) for c, value in (defaults or {}).items() if c in last.columns})
