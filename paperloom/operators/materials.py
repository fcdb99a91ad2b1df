"""Prices, costs, bulk demand and quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_list(prices: DataFrame) -> DataFrame:
    """Rows of the newest list of each key: latest date, ties to the lowest offer, line, price."""
    order = Window.partitionBy("key").orderBy(F.col("price_date").desc(), "offer", "line", "price")
    first = prices.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("key", F.col("supplier").alias("s"), F.col("price_date").alias("d"))
    return prices.join(first, "key").where((F.col("supplier") == F.col("s")) & (F.col("price_date") == F.col("d"))).drop("s", "d")


def current_price(prices: DataFrame) -> DataFrame:
    """The price in force for each key: newest list, base tier first, then lowest price."""
    order = Window.partitionBy("key").orderBy("min_qty", "price", "supplier", "offer", "line")
    return newest_list(prices).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("key", "price", "supplier", "price_date")


def bulk_price(demand: DataFrame, prices: DataFrame) -> DataFrame:
    """For demand (key, quantity): the lowest price among tiers with 0 < min_qty <= quantity in the newest list."""
    rows = demand.join(newest_list(prices).where("min_qty > 0"), "key").where("min_qty <= quantity")
    return rows.groupBy("key").agg(F.first("quantity").alias("quantity"), F.min("price").alias("bulk_price"))


def boq_cost(lines: DataFrame, current: DataFrame) -> DataFrame:
    """Bill lines (tender_id, line, key, quantity) with price, cost and PRICED or PRICE_UNAVAILABLE; each cost is rounded to cents."""
    rows = lines.join(current.select("key", "price"), "key", "left")
    status = F.when(F.col("price").isNull(), "PRICE_UNAVAILABLE").otherwise("PRICED")
    return rows.select("tender_id", "line", "key", "quantity", "price", (F.col("quantity") * F.col("price")).cast("decimal(24,8)").cast("decimal(20,2)").cast("double").alias("cost"), status.alias("status"))


def cost_by(costs: DataFrame, *keys: str) -> DataFrame:
    """Totals by tender and currency; nothing is converted."""
    return costs.groupBy(*keys).agg(F.sum(F.col("cost").cast("decimal(24,8)")).cast("decimal(20,2)").cast("double").alias("total"), F.count("price").alias("priced"), F.count_if(F.col("price").isNull()).alias("unpriced"))


def bulk_materials(costs: DataFrame, bulk: DataFrame) -> DataFrame:
    """Keys in two tenders or more: tenders, quantity, cost, cost at the bulk price, difference."""
    per = costs.groupBy("key", "tender_id").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("cost").cast("decimal(24,8)")).alias("cost"))
    rows = per.groupBy("key").agg(F.count(F.lit(1)).alias("tenders"), F.sum("quantity").alias("quantity"), F.sum("cost").cast("decimal(20,2)").cast("double").alias("cost")).where("tenders >= 2")
    rows = rows.join(bulk.select("key", "bulk_price"), "key", "left").withColumn("scenario", F.col("quantity") * F.col("bulk_price"))
    return rows.select("key", "tenders", "quantity", "cost", "bulk_price", "scenario", (F.col("cost") - F.col("scenario")).alias("difference"))


#: Weights of a quotation's parts, and the least fit that can win.
WEIGHTS, LEAST_FIT = {"fit": 0.4, "price": 0.3, "duration": 0.2, "terms": 0.1}, 60


def score_quotations(quotes: DataFrame) -> DataFrame:
    """Score of each quotation (rfq, offer, contractor, price, duration, fit, terms) against its request's best.

    Parts are relative to the least price, least duration and longest terms of the request; best is the
    highest score among those with enough fit, ties to the lowest contractor, offer and duration.
    """
    group = Window.partitionBy("rfq")
    positive = lambda c: F.min(F.when(F.col(c) > 0, F.col(c))).over(group)
    part = {
        "fit": F.least(F.greatest(F.col("fit"), F.lit(0.0)), F.lit(100.0)) / 100,
        "price": F.when(F.col("price") > 0, positive("price") / F.col("price")).otherwise(0.0),
        "duration": F.when(F.col("duration") > 0, positive("duration") / F.col("duration")).otherwise(0.0),
        "terms": F.coalesce(F.col("terms") / F.nullif(F.max("terms").over(group), F.lit(0.0)), F.lit(0.0)),
    }
    total = sum((F.lit(w) * part[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = quotes.withColumn("score", F.bround(100 * total, 1)).withColumn("eligible", F.col("fit") >= LEAST_FIT)
    rank = F.row_number().over(Window.partitionBy("rfq", "eligible").orderBy(F.col("score").desc(), "contractor", "offer", "duration", "price"))
    return rows.select("rfq", "contractor", "offer", "duration", "score", "eligible", (F.col("eligible") & (rank == 1)).alias("best"))
