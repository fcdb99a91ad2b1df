"""Requirement candidates from page text: discovery, reject ladder, deduplication passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def discover(pages: DataFrame, rejects: bool = True) -> DataFrame:
    """One row per sentence of pages (document, page, text): line, n, sentence, signals, reason, seq.

    reason is the first that holds: SKIPPED_TINY_INPUT (one row a page, whose text is short), REJECTED_TINY,
    REJECTED_OCR_GARBAGE, REJECTED_NO_SIGNAL, REJECTED_MIXED_MULTI, over_parent_cap; null if accepted.
    The sentences of a page are one array: they are judged, numbered and capped in it, so that nothing is shuffled.
    Without rejects only accepted ones are returned, and sentences without a signal are not judged.
    """
    tiny = F.length(F.trim("text")) < T.TINY_PARENT
    columns = ["document", "page", "line", "n", "sentence", "signals", "reason", "seq"]
    none = [F.lit(0).alias("line"), F.lit(0).alias("n"), F.lit("").alias("sentence"), F.lit("").alias("signals"), F.lit("SKIPPED_TINY_INPUT").alias("reason"), F.lit(None).cast("int").alias("seq")]
    skipped = pages.where(tiny).select("document", "page", *none)

    def row(s: Column, signals: Column, reason: Column, seq: Column) -> Column:
        return F.struct(s["line"].alias("line"), s["n"].alias("n"), s["sentence"].alias("sentence"), signals.alias("signals"), reason.alias("reason"), seq.cast("int").alias("seq"))

    def judge(s: Column) -> Column:
        early = F.when(F.length(s["sentence"]) < T.LEAST_CHARS, "REJECTED_TINY").when(T.printable_ratio(s["sentence"]) < T.LEAST_PRINTABLE, "REJECTED_OCR_GARBAGE")
        named = lambda h: row(s, F.array_join(h, ","), F.coalesce(early, F.when(F.size(h) == 0, "REJECTED_NO_SIGNAL").when(F.size(h) > T.MOST_SIGNALS, "REJECTED_MIXED_MULTI")), F.lit(None))
        hits = F.when(F.rlike(F.lower(s["sentence"]), F.lit(T.ANY_SIGNAL)), T.signals(s["sentence"])).otherwise(F.array().cast("array<string>"))
        return F.transform(F.array(hits), named)[0]

    def number(s: Column, at: Column) -> Column:
        over = at >= T.MOST_ACCEPTED
        return row(s, s["signals"], F.when(over, "over_parent_cap"), F.when(~over, at + 1))

    parts = T.sentences(F.col("text"))
    if not rejects:
        parts = F.filter(parts, lambda s: F.lower(s["sentence"]).rlike(T.ANY_SIGNAL))
    held = pages.where(~tiny).select("document", "page", F.transform(parts, judge).alias("judged"))
    accepted = F.transform(F.filter("judged", lambda s: s["reason"].isNull()), number)
    if not rejects:
        return held.select("document", "page", F.inline_outer(accepted)).where("sentence is not null and reason is null").select(columns)  # outer: else pages are judged twice
    rejected = F.filter("judged", lambda s: s["reason"].isNotNull())
    return skipped.select(columns).union(held.select("document", "page", F.inline(F.concat(accepted, rejected))).select(columns))


def exact_duplicates(candidates: DataFrame) -> DataFrame:
    """Mark candidates (document, id, sentence): kept_id is the first id with the same text in the document."""
    return candidates.withColumn("kept_id", F.min("id").over(Window.partitionBy("document", "sentence")))


def normalized_duplicates(candidates: DataFrame) -> DataFrame:
    """As exact_duplicates, on the comparison form of the text."""
    rows = candidates.withColumn("form", T.normal_form(F.col("sentence")))
    return rows.withColumn("kept_id", F.min("id").over(Window.partitionBy("document", "form")))


def duplicate_groups(candidates: DataFrame) -> DataFrame:
    """Comparison forms that stand in two documents or more: form, documents, rows, first id."""
    rows = candidates.withColumn("form", T.normal_form(F.col("sentence")))
    return rows.groupBy("form").agg(F.countDistinct("document").alias("documents"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id")).where("documents > 1")


def work_queue(candidates: DataFrame, most: int) -> DataFrame:
    """Position of each candidate of a document: signals, length, id; rows over most are marked dropped."""
    n = F.size(F.split("signals", ","))
    order = Window.partitionBy("document").orderBy(n.desc(), F.length("sentence").desc(), "id")
    return candidates.withColumn("position", F.row_number().over(order)).withColumn("dropped", F.col("position") > most)
