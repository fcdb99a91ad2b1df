"""Groups of ambiguity signals that say the same, and the audit that none was lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import similarity

NEAR = 0.9


def _keyed(signals: DataFrame) -> DataFrame:
    """signals with norm, the description's normal form, and key, a digest of kind, document and norm, null or not."""
    rows = signals.withColumn("norm", T.normal_form(F.coalesce("description", F.lit(""))))
    return rows.withColumn("key", F.sha2(F.to_json(F.struct("kind", "document", "norm")), 256))


def _exact(signals: DataFrame) -> DataFrame:
    """One row for each text that a document says of one kind: id (the least), signals, first_page, last_page, description (the longest)."""
    rows = _keyed(signals)
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("id")))
    return rows.groupBy("key", "kind", "document", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("signals"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), longest.alias("description"))


def ambiguity_groups(signals: DataFrame, least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Groups, and members (id, group_id) of signals (id, kind, document, page, description).

    Signals of one kind and document are one group if their normal forms are equal. Of those that stand on one page only, such as are alike by
    least (Jaccard of words) on that page join the first by id that they are like; the similarity join stays within a page, and nothing
    crosses documents. A group has the longest description, of equal ones the first. Null descriptions are empty; ids are unique.
    Groups: group_id (the first signal's id), kind, document, description, signals, first_page, last_page.
    """
    similarity.checkpoint_folder(signals.sparkSession)
    exact = _exact(signals).checkpoint()
    one_page = exact.where("first_page = last_page")
    rows = one_page.select(F.concat_ws("\u0001", "kind", "document", "first_page").alias("block"), "id", T.tokens(F.col("norm")).alias("tokens"))
    links = similarity.jaccard_pairs(rows.where(F.size("tokens") > 0), least).select("a", "b")
    led = similarity.leaders(rows.select("id"), links)
    exact = exact.join(led, "id", "left").withColumn("group_id", F.coalesce("leader", "id"))
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("id")))
    groups = exact.groupBy("group_id", "kind", "document").agg(longest.alias("description"), F.sum("signals").alias("signals"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    members = _keyed(signals).select("id", "key").join(exact.select("key", "group_id"), "key")
    return groups, members.select("id", "group_id")


def audit(signals: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: raw signals, groups, reduction in per cent, and whether every signal is in just one group and groups count them all."""
    per = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    held = signals.select("id").join(per, "id", "full").agg(F.count(F.lit(1)).alias("raw"), F.coalesce(F.bool_and(F.coalesce("n", F.lit(0)) == 1), F.lit(True)).alias("once"), F.lit(1).alias("k"))
    made = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("signals"), F.lit(0)).alias("counted"), F.lit(1).alias("k"))
    reduction = F.when(F.col("raw") > 0, F.bround(100.0 * (F.col("raw") - F.col("groups")) / F.col("raw"), 1)).otherwise(0.0)
    return held.join(made, "k").select("raw", "groups", reduction.alias("reduction"), (F.col("once") & (F.col("counted") == F.col("raw"))).alias("whole"))
