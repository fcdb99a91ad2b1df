"""Filters, joins and roll-ups over tenders, issues, votes, files and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, me: int | None, admin: bool = False, shared: int | None = None) -> DataFrame:
    """Rows (id, owner) of an owner; those of none for an admin; all where nobody is signed in; always the shared one."""
    if me is None:
        return rows
    mine = F.coalesce(F.col("owner") == me, F.lit(False)) | (F.col("owner").isNull() & F.lit(admin))
    return rows.where(mine | (F.col("id").eqNullSafe(F.lit(shared)) if shared is not None else F.lit(False)))


def active(tenders: DataFrame) -> DataFrame:
    """Tenders without outcome whose stage is not closed and whose decision is not NO_GO; nulls are none of these."""
    return tenders.where(F.col("outcome").isNull() & ~F.col("stage").eqNullSafe("CLOSED") & ~F.col("decision").eqNullSafe("NO_GO"))


def issue_order(issues: DataFrame, limit: int) -> DataFrame:
    """The first limit issues (id, status, priority, at): open first, then by priority, time and id."""
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    rows = issues.withColumn("closed", (F.col("status") != "OPEN").cast("int")).withColumn("rank", rank)
    return rows.orderBy("closed", "rank", "at", "id").limit(limit).drop("closed", "rank")


def clean_weight(raw: Column, default: float) -> Column:
    """A weight from text: the default if it is no number, kept within 0 and 100."""
    return F.least(F.greatest(F.coalesce(raw.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(100.0))


def clean_weights(rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """All columns of defaults cleaned; the defaults where all are zero."""
    rows = rows.withColumns({c: clean_weight(F.col(c), d) for c, d in defaults.items()})
    none = sum((F.col(c) for c in defaults), F.lit(0.0)) == 0
    return rows.select(*[F.when(none, F.lit(defaults[c])).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def boq_conflicts(items: DataFrame) -> DataFrame:
    """Item codes (item, quantity, unit, price, total) with several distinct figures: rows and variants."""
    rows = items.withColumn("code", F.upper(F.trim("item"))).where("code <> ''")
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("quantity", "unit", "price", "total")]
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*held)).alias("variants")).where("variants > 1")


def unread_pages(pages: DataFrame, shown: int = 20) -> DataFrame:
    """Documents with scanned pages (document, page, ocr, confidence, chars) under 0.55 or 30 characters: how many, the first shown."""
    bad = pages.where(F.col("ocr") & ((F.col("confidence") < 0.55) | (F.col("chars") < 30)))
    held = F.array_sort(F.collect_set("page"))
    return bad.groupBy("document").agg(F.countDistinct("page").alias("pages"), F.array_join(F.slice(held, 1, shown), ",").alias("shown"))


def package_gaps(documents: DataFrame) -> DataFrame:
    """Documents (document, status, failed, chars) that are not fully read, with the kind of gap."""
    kind = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "UNSUPPORTED", "unsupported").when(F.col("status") == "FAILED", "failed").when(F.col("status") == "PARTIAL", "partly-read").when(F.col("chars") == 0, "empty-text")
    return documents.withColumn("kind", kind).where("kind is not null")


def coverage(documents: DataFrame, *keys: str) -> DataFrame:
    """Documents by status for keys: read share in per cent and the state of the whole."""
    rows = documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "COMPLETE").alias("complete"), F.count_if(F.col("status") == "PARTIAL").alias("part"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    state = F.when(F.col("failed") == F.col("documents"), "FAILED").when(F.col("complete") == F.col("documents"), "COMPLETE").otherwise("PARTIAL")
    return rows.withColumn("percent", F.bround(100.0 * (F.col("complete") + F.col("part")) / F.col("documents"), 1)).withColumn("state", state)


def mentions_mode(mentions: DataFrame, key: str, value: str) -> DataFrame:
    """The value (with weight) that each key mentions most; the first by name of equal ones."""
    rows = mentions.groupBy(key, value).agg(F.sum("weight").alias("mentions"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("mentions").desc(), value))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def latest_wins(current: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each of keys, the latest by at; incoming before current where they tie."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("__new").desc()))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__new")


def chosen(quotes: DataFrame, choice: DataFrame) -> DataFrame:
    """Quotes (rfq, id) with selected: true for the one chosen (rfq, chosen), false for the others of its request, else as it was."""
    rows = quotes.join(choice, "rfq", "left")
    return rows.withColumn("selected", F.when(F.col("chosen").isNull(), F.col("selected")).otherwise(F.col("id") == F.col("chosen"))).drop("chosen")


def drifted(evidence: DataFrame, requirements: DataFrame) -> DataFrame:
    """Evidence (id, requirement, chunk) with why it is refused: an unknown requirement, or a chunk other than the requirement's."""
    rows = evidence.join(requirements.select("requirement", F.col("chunk").alias("own")), "requirement", "left")
    why = F.when(F.col("own").isNull(), "ORPHAN").when(F.split("chunk", "-seg-")[0] != F.split("own", "-seg-")[0], "DRIFT")
    return rows.select("id", "requirement", why.alias("refused"))
