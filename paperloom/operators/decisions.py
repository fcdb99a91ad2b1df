"""Requirement statuses, tender decisions, compliance and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def requirement_status(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add n_evidence and status to requirements (tender_id, line, ...).

    evidence: tender_id, line, status, mismatch, expired. Without applicable evidence MISSING_EVIDENCE; then
    expired or conflicting evidence gives REVIEW, any FAIL gives FAIL, any REVIEW gives REVIEW, else PASS.
    Evidence is summed per requirement before the join, so the join sees one row a requirement.
    """
    ok = ~F.col("mismatch")
    is_ = lambda s: _count(ok & (F.col("status") == s))
    per = evidence.groupBy("tender_id", "line").agg(F.count(F.lit(1)).alias("n_evidence"), _count(ok).alias("n_ok"), _count(ok & F.col("expired")).alias("n_expired"), is_("PASS").alias("n_pass"), is_("FAIL").alias("n_fail"), is_("REVIEW").alias("n_review"))
    conflict = ((F.col("n_fail") > 0) & (F.col("n_pass") > 0)) | ((F.col("n_review") > 0) & (F.col("n_fail") + F.col("n_pass") > 0))
    status = F.when(F.coalesce("n_ok", F.lit(0)) == 0, "MISSING_EVIDENCE").when((F.col("n_expired") > 0) | conflict, "REVIEW").when(F.col("n_fail") > 0, "FAIL").when(F.col("n_review") > 0, "REVIEW").otherwise("PASS")
    joined = requirements.join(per, ["tender_id", "line"], "left")
    return joined.select(*[requirements[c] for c in requirements.columns], F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), status.alias("status"))


def tender_decision(tenders: DataFrame, statuses: DataFrame, risks: DataFrame) -> DataFrame:
    """One row per tender (tender_id): counts, rule, decision, confidence, blockers (six at most, contradictions first)."""
    gate, missing = F.col("requirement_type") == "HARD_GATE", F.col("status").isin("MISSING_EVIDENCE", "REVIEW")
    due = statuses.where("mandatory")
    mark = F.concat(F.col("category"), F.lit("/"), F.col("line"))
    blocker = F.when(~gate & (F.col("status") == "FAIL"), F.struct(F.lit(0).alias("o"), "line", F.concat(mark, F.lit(" [CONTRADICTED]")).alias("text"))).when(missing, F.struct(F.lit(1).alias("o"), "line", F.when(F.col("status") == "REVIEW", F.concat(mark, F.lit(" [REVIEW]"))).otherwise(mark).alias("text")))
    per = due.groupBy("tender_id").agg(
        _count(gate & (F.col("status") == "FAIL")).alias("gate_fail"),
        _count(~gate & (F.col("status") == "FAIL")).alias("contradicted"),
        _count(gate & (F.col("status") == "MISSING_EVIDENCE")).alias("gate_missing"),
        _count(gate & (F.col("status") == "REVIEW")).alias("gate_review"),
        _count(~gate & missing).alias("gaps"),
        F.collect_list(blocker).alias("held"),
    )
    high = risks.groupBy("tender_id").agg(_count(F.col("severity") == "HIGH").alias("high_risks"))
    counts = ["gate_fail", "contradicted", "gate_missing", "gate_review", "gaps", "high_risks"]
    rows = tenders.join(per, "tender_id", "left").join(high, "tender_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rules = (("gate_fail", "HARD_GATE_FAIL"), ("contradicted", "MANDATORY_REQUIREMENT_CONTRADICTED"), ("gate_missing", "MANDATORY_GATE_MISSING"), ("gate_review", "MANDATORY_GATE_REVIEW"), ("gaps", "EXPERIENCE_EVIDENCE_MISSING"), ("high_risks", "COMMERCIAL_RISK_REVIEW"))
    rule = F.coalesce(*[F.when(F.col(c) > 0, F.lit(name)) for c, name in rules], F.lit("ALL_MANDATORY_PASS"))
    rows = rows.withColumn("rule", rule)
    decision = F.when(F.col("rule") == "HARD_GATE_FAIL", "NO_BID").when(F.col("rule") == "ALL_MANDATORY_PASS", "BID").otherwise("REVIEW")
    sure = F.when(F.col("decision") != "REVIEW", "HIGH").when(F.col("rule") == "COMMERCIAL_RISK_REVIEW", "MEDIUM").otherwise("LOW")
    blockers = F.array_join(F.transform(F.slice(F.array_sort(F.coalesce("held", F.array())), 1, 6), lambda b: b["text"]), "; ")
    return rows.withColumn("decision", decision).select("tender_id", *counts, "rule", "decision", sure.alias("confidence"), blockers.alias("blockers"))


def compliance(statuses: DataFrame) -> DataFrame:
    """Counts of each status over mandatory rows, and percent passed, null when nothing was evaluated."""
    n = {s: _count(F.col("status") == s) for s in ("PASS", "FAIL", "REVIEW", "MISSING_EVIDENCE")}
    rows = statuses.where("mandatory").groupBy("tender_id").agg(*[c.alias(f"n_{s.lower()}") for s, c in n.items()], F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.bround(100.0 * F.col("n_pass") / F.nullif("n", F.lit(0)), 0))


def explanation(statuses: DataFrame) -> DataFrame:
    """Sizes of the parts of a decision's explanation: hard failures, gaps, supporting rows, evidence read."""
    gate = F.col("requirement_type") == "HARD_GATE"
    return statuses.groupBy("tender_id").agg(_count(gate & (F.col("status") == "FAIL")).alias("hard_failures"), _count(F.col("status").isin("MISSING_EVIDENCE", "REVIEW")).alias("gaps"), _count(F.col("status").isin("PASS", "FAIL")).alias("supporting"), F.sum("n_evidence").alias("evidence"))


def missing_evidence(statuses: DataFrame, lookup: DataFrame) -> DataFrame:
    """Open rows (MISSING_EVIDENCE or REVIEW) with priority and owner by category, defaults where lookup has none."""
    rows = statuses.where(F.col("status").isin("MISSING_EVIDENCE", "REVIEW")).join(lookup, "category", "left")
    return rows.select("tender_id", "line", "category", "status", F.coalesce("priority", F.when(F.col("mandatory"), "HIGH").otherwise("MEDIUM")).alias("priority"), F.coalesce("owner", F.lit("Bid manager")).alias("owner"))


def rank() -> Column:
    """Rank of a status in lists of gaps."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in (("FAIL", 0), ("REVIEW", 1), ("MISSING_EVIDENCE", 2), ("PASS", 3)) for x in kv]), F.col("status"))


def gap_list(statuses: DataFrame, most: int = 15) -> DataFrame:
    """The first rows of each tender that are not PASS: FAIL, REVIEW, MISSING_EVIDENCE, then by line."""
    order = Window.partitionBy("tender_id").orderBy(rank(), "line")
    rows = statuses.where("status <> 'PASS'").withColumn("position", F.row_number().over(order))
    return rows.where(F.col("position") <= most).select("tender_id", "position", "line", "category", "status")


def decision_detail(statuses: DataFrame) -> DataFrame:
    """All rows of each tender in reading order: mandatory first, then by status rank, category and line."""
    order = Window.partitionBy("tender_id").orderBy(F.col("mandatory").desc(), rank(), "category", "line")
    return statuses.select("tender_id", "line", "category", "mandatory", "status", F.row_number().over(order).alias("position"))


def weighted_score(factors: DataFrame) -> DataFrame:
    """Score of each tender from factors (tender_id, factor, value, weight, hard_fail), over those with a value.

    score is the rounded weighted mean, band GO from 70, REVIEW from 50, else NO_GO; hard_fail forces NO_GO.
    """
    known = F.col("value").isNotNull() & (F.col("weight") > 0)
    total = F.sum(F.when(known, F.col("weight")))
    per = factors.groupBy("tender_id").agg((F.sum(F.when(known, F.col("weight") * F.col("value"))) / total).alias("mean"), total.alias("weight"), F.bool_or("hard_fail").alias("hard_fail"))
    per = per.withColumn("score", F.bround("mean", 0).cast("long"))
    band = F.when(F.col("score").isNull(), None).when(F.col("hard_fail"), "NO_GO").when(F.col("score") >= 70, "GO").when(F.col("score") >= 50, "REVIEW").otherwise("NO_GO")
    return per.select("tender_id", "score", F.coalesce("weight", F.lit(0.0)).alias("weight"), band.alias("band"))
