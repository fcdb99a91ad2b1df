"""Figures over all tenders of an account: votes, outcomes, suppliers, states, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Half-even rounded percentage, null when whole is 0."""
    return F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 0)


def vote_summary(votes: DataFrame) -> DataFrame:
    """Approve, reject and abstain per tender, and per tender and department (null: all departments)."""
    n = {v: F.count_if(F.col("vote") == v.upper()) for v in ("approve", "reject", "abstain")}
    rows = votes.groupingSets([["tender_id"], ["tender_id", "department"]], "tender_id", "department").agg(*[c.alias(v) for v, c in n.items()])
    return rows.withColumn("percent", percent(F.col("approve"), F.col("approve") + F.col("reject")))


def win_rate(tenders: DataFrame, *keys: str) -> DataFrame:
    """Tenders, wins, losses and win rate over decided ones, by keys."""
    rows = tenders.groupBy(*keys).agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.col("outcome") == "WON").alias("won"), F.count_if(F.col("outcome") == "LOST").alias("lost"))
    return rows.withColumn("win_rate", percent(F.col("won"), F.col("won") + F.col("lost")))


def supplier_history(quotes: DataFrame) -> DataFrame:
    """Per discipline and supplier: quotes, selected, average fit, distinct tenders."""
    return quotes.groupBy("discipline", "supplier").agg(F.count(F.lit(1)).alias("quotes"), F.count_if("selected").alias("selected"), F.bround(F.sum(F.col("fit").cast("decimal(12,4)")) / F.count("fit"), 2).cast("double").alias("avg_fit"), F.countDistinct("tender_id").alias("tenders"))


def top_suppliers(history: DataFrame, most: int = 5) -> DataFrame:
    """The first suppliers of each discipline: selected, average fit, quotes, then name."""
    order = Window.partitionBy("discipline").orderBy(F.col("selected").desc(), F.col("avg_fit").desc(), F.col("quotes").desc(), "supplier")
    return history.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by the order columns."""
    by = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def within_limit(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Events (key, ts, id) with recent, the events of the key in the seconds up to each one, and blocked, when over most."""
    frame = Window.partitionBy(key).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    rows = events.withColumn("recent", F.count(F.lit(1)).over(frame))
    return rows.withColumn("blocked", F.col("recent") > most)


def index_percentile(rows: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """For each share p the value at index floor(p n) of the sorted values of a group; rows without a value come first.

    Equal values are counted first, and only running sums of the counts are ordered: those of 1,000 value ranges of a
    group, and within a range its own distinct values, so that no group is sorted in one task.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    bounds = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    place = F.when(F.col(value).isNull(), -1).when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 999)).otherwise(0)
    counts = counts.join(bounds, same).withColumn("bin", place.cast("int")).drop(*[f"__{k}" for k in keys])
    bins = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("b"))
    before = F.sum("b").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("b")
    bins = bins.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), before.alias("start"))
    inner = Window.partitionBy(*keys, "bin").orderBy(F.col(value).asc_nulls_first())
    ranked = counts.join(bins, [*same, F.col("bin") == F.col("__bin")]).withColumn("end", F.col("start") + F.sum("c").over(inner))
    index = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    held = lambda p: (index(p) >= F.col("end") - F.col("c")) & (index(p) < F.col("end"))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(held(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


def scores_of_sets(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """true and false positives, false negatives, precision, recall and F1 of two sets of keys."""
    both = predicted.select(key, F.lit(1).alias("p")).distinct().join(gold.select(key, F.lit(1).alias("g")).distinct(), key, "full_outer")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.bround(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro_f1(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """F1 of each class of pairs (predicted, gold), 1 when a class is empty on both sides; support and the macro mean."""
    rows = pairs.select(F.explode(F.array(*map(F.lit, classes))).alias("class"), "predicted", "gold")
    is_p, is_g = F.col("predicted").eqNullSafe(F.col("class")), F.col("gold").eqNullSafe(F.col("class"))
    rows = rows.groupBy("class").agg(F.count_if(is_p & is_g).alias("tp"), F.count_if(is_p & ~is_g).alias("fp"), F.count_if(~is_p & is_g).alias("fn"))
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    rows = rows.withColumn("f1", F.bround(f1, 4))
    return rows.withColumn("macro_f1", F.bround(F.avg(F.col("f1").cast("decimal(9,4)")).over(Window.partitionBy()), 4).cast("double"))
