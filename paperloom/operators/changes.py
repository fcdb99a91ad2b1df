"""Changes applied to tables, and nested exports of a tender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def sync_issues(current: DataFrame, wanted: DataFrame, retire: tuple[str, ...]) -> DataFrame:
    """current (key, kind, status, answered) after wanted (key, kind): new keys come in as OPEN, known ones stay as they are.

    Open unanswered rows of the retire kinds that are no longer wanted go. Running it twice changes nothing.
    """
    keys = wanted.dropDuplicates(["key"])
    old = F.col("kind").isin(*retire) & (F.col("status") == "OPEN") & ~F.col("answered")
    stale = current.where(old).join(keys, "key", "left_anti")
    added = keys.join(current, "key", "left_anti").select("key", "kind", F.lit("OPEN").alias("status"), F.lit(False).alias("answered"))
    return current.join(stale, "key", "left_anti").unionByName(added)


def confident_rows(rows: DataFrame, sure: float = 0.7) -> DataFrame:
    """rows (id, key, document, confidence) without the less sure of a key; others of another document stay when both are above sure."""
    best = Window.partitionBy("key").orderBy(F.col("confidence").desc(), "id")
    rows = rows.withColumns({"nth": F.row_number().over(best), "best_document": F.first("document").over(best), "best_sure": F.first("confidence").over(best)})
    per = rows.withColumn("in_document", F.row_number().over(Window.partitionBy("key", "document").orderBy(F.col("confidence").desc(), "id")))
    other = (F.col("document") != F.col("best_document")) & (F.col("in_document") == 1) & (F.col("confidence") > sure) & (F.col("best_sure") > sure)
    return per.where((F.col("nth") == 1) | other).select("id", "key", "document", "confidence")


def replace_groups(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with all rows of the keys of incoming replaced by those of incoming."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def stale_decisions(decisions: DataFrame, version: int) -> DataFrame:
    """Keys whose latest decision (tender_id, at, id, version, override) is older than version and was not set by hand."""
    order = Window.partitionBy("tender_id").orderBy(F.col("at").desc(), F.col("id").desc())
    last = decisions.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return last.where(~F.col("override") & (F.col("version") < version)).select("tender_id", "id", "version")


def compliance_matrix(statuses: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per requirement with up to three evidences as text, the status and what is missing, safe as cells of a sheet.

    evidence: tender_id, line, fact. The three are the least by text, kept by rank.
    """
    nth = F.row_number().over(Window.partitionBy("tender_id", "line").orderBy("fact"))
    three = evidence.withColumn("nth", nth).where("nth <= 3").groupBy("tender_id", "line").agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("evidence"))
    gap = F.when(F.col("status") == "MISSING_EVIDENCE", "No evidence").when(F.col("status") == "REVIEW", "Needs review").when(F.col("status") == "FAIL", "Contradicted").otherwise("")
    rows = statuses.join(three, ["tender_id", "line"], "left")
    return rows.select("tender_id", "line", "category", "status", T.formula_safe(F.coalesce("evidence", F.lit(""))).alias("evidence"), gap.alias("gap"))


def export_tender(decisions: DataFrame, statuses: DataFrame, risks: DataFrame) -> DataFrame:
    """tender_id and a JSON document of its decision, requirements by line, and risk severities.

    Requirements and risks are summed up per tender before the join; a tender's own rows are few.
    """
    reqs = statuses.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("line", "category", "status"))).alias("requirements"))
    held = risks.groupBy("tender_id").agg(F.array_sort(F.collect_list("severity")).alias("risks"))
    rows = decisions.join(reqs, "tender_id", "left").join(held, "tender_id", "left")
    body = F.struct("decision", "rule", F.coalesce("requirements", F.array()).alias("requirements"), F.coalesce("risks", F.array()).alias("risks"))
    return rows.select("tender_id", F.to_json(body).alias("body"))
