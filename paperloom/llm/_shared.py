"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with this share of the rows is heavy; there are at most 1 / HEAVY of them. So many rows one task may hold, whatever their keys.
HEAVY, ONE_TASK = 1 / 2000, 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine.

    A cluster without such a folder is an error: tables on each machine's own disk would be lost to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get()
    return named.rstrip("/")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs nothing twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(*key: F.Column) -> F.Column:
    """A fixed random order: the hex MD5 of the key, which any SQL engine can repeat."""
    return F.md5(F.concat_ws("/", *[F.coalesce(k.cast("string"), F.lit("null")) for k in key]))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, rows: int, per_slice: int = 256) -> DataFrame:
    """Add out: the sum of value up to and including each row, within group by order.

    order[0] must hold an MD5 in hex. Its head deals each group into slices of about per_slice rows or
    fewer, so that a group with a third of all rows is spread over many tasks: slices are summed, the
    sums are added up over blocks of slices and over the slices of a block, and each slice is then totalled on its own.
    """
    slices = max(1, -(-rows // per_slice))
    head = F.conv(F.substring(order[0], 1, 8), 16, 10).cast("long")
    df = df.withColumn("__slice", F.floor(head * F.lit(slices) / F.lit(2.0**32)).cast("long"))
    keys, earlier = [*group, "__slice"], (Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum")).withColumn("__block", F.floor(F.col("__slice") / 4096))
    blocks = sums.groupBy(*group, "__block").agg(F.sum("__sum").alias("__all"))
    over_blocks = Window.partitionBy(*group).orderBy("__block").rowsBetween(*earlier)
    blocks = blocks.select(*group, "__block", F.coalesce(F.sum("__all").over(over_blocks), F.lit(0)).alias("__blocks"))
    in_block = Window.partitionBy(*group, "__block").orderBy("__slice").rowsBetween(*earlier)
    sums = sums.join(blocks, [*group, "__block"]).select(*keys, (F.coalesce(F.sum("__sum").over(in_block), F.lit(0)) + F.col("__blocks")).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(sums, keys).withColumn(out, F.sum(value).over(inside) + F.col("__before"))
    return joined.drop("__slice", "__before")


def ordered_totals(df: DataFrame, order: list[str], values: dict[str, str], rows: int | None = None) -> DataFrame:
    """df with the sum of each of values, {column: name of its total}, up to and including each row by order.

    Rows are range-sorted, the ranges are summed, and each range is then totalled on its own; order should name every row.
    If rows, the number of rows, is given and one task may hold them, they are summed there.
    """
    if rows is not None and rows <= ONE_TASK:
        return df.withColumns({out: F.sum(v).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for v, out in values.items()})
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("__range", F.spark_partition_id())
    ranged = shared_table(ranged, "ranged")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"__{out}") for v, out in values.items()])
    sums = sums.select("__range", *[F.coalesce(F.sum(f"__{out}").over(earlier), F.lit(0)).alias(f"__{out}") for out in values.values()])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(sums), "__range")  # one row a range
    joined = joined.withColumns({out: F.sum(v).over(inside) + F.col(f"__{out}") for v, out in values.items()})
    return joined.drop("__range", *[f"__{out}" for out in values.values()])


def first_of_each(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(doc_id, key) of at most limit rows of each key, the first by MD5 of doc_id; rows without doc_id are left out.

    The head of the MD5 deals each key into 4,096 bins in order. Bins are counted first, and only those that start
    below limit are kept: limit rows and one bin's. Those are cut to limit in each of 256 slices of a key, then in
    the key, so that no task sees a whole hot key whatever the input.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(key).isNotNull()).select("doc_id", key).distinct().withColumn("__pos", F.md5(F.col("doc_id").cast("string")))
    rows = rows.withColumn("__bin", F.conv(F.substring("__pos", 1, 3), 16, 10).cast("int")).withColumn("__slice", F.substring("__pos", 4, 2))
    before = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(key, "__bin").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rows = rows.join(bins.where(F.col("__before") < limit).select(key, "__bin"), [key, "__bin"], "left_semi")
    order = ["__pos", "doc_id"]
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__slice").orderBy(*order))).where(F.col("__nth") <= limit)
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__nth") <= limit)
    return rows.select("doc_id", key)


def whole_row(docs: DataFrame) -> F.Column:
    """All columns of docs as one struct, so that no name of theirs, with a dot or not, meets one of ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def line_digest(docs: DataFrame) -> F.Column:
    """SHA-256 of a whole row: rows share it only if they are alike in every column."""
    return F.sha2(F.to_json(whole_row(docs)), 256)


def lines_once(docs: DataFrame) -> DataFrame:
    """(line, held): the line_digest of docs and the row itself; of rows alike in every column one. Copies go before the shuffle, so none is gathered."""
    rows = docs.select(line_digest(docs).alias("line"), whole_row(docs).alias("held"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("line").orderBy("line"))).where("nth = 1").drop("nth")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose line_digest is in kept (line); of rows alike in every column, one. The text is shuffled once.

    It lies by line already, so kept is merged with it; whatever size Spark takes it for, it is never broadcast.
    """
    return lines_once(docs).join(kept.select("line").hint("merge"), "line", "left_semi").select("held.*")


def split_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with per_key, which has one row for each key; how is inner or left.

    Keys with a share HEAVY of rows, 1 / HEAVY at most, are broadcast with what per_key says of them, so that their rows
    stay where they lie. Both frames must give the same rows whenever they are read. So few rows that one task may hold
    them all need no split.
    """
    n = rows.count()
    if n <= ONE_TASK:
        return rows.join(per_key, key, how)
    least = max(64, HEAVY * n)
    heavy = rows.groupBy(key).count().where((F.col("count") >= least) & F.col(key).isNotNull()).select(key)
    heavy = shared_table(heavy.join(per_key.withColumn("__known", F.lit(True)), key, "left"), "heavy")
    if heavy.isEmpty():
        return rows.join(per_key, key, how)
    hot = rows.join(F.broadcast(heavy), key)
    hot = (hot if how == "left" else hot.where("__known")).drop("__known")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(per_key, key, how)
    return hot.unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that it reaches.

    Rounds of large-star and small-star on the edge table: hubs shrink in every round, a component is
    never gathered in one place, and each round is a table of its own in the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = shared_table(links, "links")
    while True:
        few = 2 * links.count() <= ONE_TASK
        held = (lambda df, label: df) if few else shared_table  # a split reads its frames more than once
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = held(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        join = (lambda rows, per_key: rows.join(per_key, "a")) if few else (lambda rows, per_key: split_join(rows, per_key, "a"))
        large = join(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = held(large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), "large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join(large, lower).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = shared_table(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        inner = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
        repeated = links.groupBy("a").count().where("count > 1")
        if inner.isEmpty() and repeated.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
