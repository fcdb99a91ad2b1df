"""Readers of the star-schema tables, and their stand-ins for tender records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requirement categories, in order.
CATEGORIES = ("LEGAL", "SUBMISSION", "HSE", "QA_QC", "COMMERCIAL", "PERSONNEL", "SUBCONTRACTOR", "SCHEDULE", "TECHNICAL", "FINANCIAL", "EXPERIENCE", "GENERAL")
#: Evidence shipped before this date counts as expired.
AS_OF = "1995-02-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, small: int = 16 << 20) -> DataFrame:
    """rows dealt over all cores if there are less than small bytes for each, so that it costs little: a small file is often one partition.

    Larger inputs lie in many partitions and stay where they are; the rows are the same either way.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < cores * small else rows


def requirements(lineitem: DataFrame) -> DataFrame:
    """tender_id, line, part, category, mandatory, requirement_type: one per order and line number."""
    rows = lineitem.groupBy(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("part") % 12 + 1).cast("int"))
    kind = F.when(F.col("part") % 6 == 0, "HARD_GATE").otherwise("QUALIFICATION")
    return rows.select("tender_id", "line", "part", category.alias("category"), (F.col("line") <= 4).alias("mandatory"), kind.alias("requirement_type"))


def evidence(lineitem: DataFrame) -> DataFrame:
    """tender_id, line, status, mismatch, expired: one per order line that has evidence."""
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 8 == 0), "FAIL").when((F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 9 == 0), "REVIEW").otherwise("PASS")
    rows = lineitem.where("l_partkey % 11 <> 0")
    return rows.select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line"), status.alias("status"), (F.col("l_suppkey") % 20 == 0).alias("mismatch"), (F.to_date("l_shipdate") < F.lit(AS_OF).cast("date")).alias("expired"))


def risks(orders: DataFrame) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM")
    return orders.select(F.col("o_orderkey").alias("tender_id"), severity.alias("severity")).where("severity is not null")


def quotations(lineitem: DataFrame) -> DataFrame:
    """rfq, contractor, price, duration, fit, terms: a part is a request, a line an offer."""
    return lineitem.select(F.col("l_partkey").alias("rfq"), F.col("l_suppkey").alias("contractor"), F.col("l_orderkey").alias("offer"), F.col("l_linenumber").alias("duration"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (100 * (1 - F.col("l_discount"))).alias("fit"), (F.col("l_tax") * 1000).alias("terms"), "l_quantity")


def prices(lineitem: DataFrame) -> DataFrame:
    """key, supplier, price_date, min_qty, price, offer, line: lists are (supplier, ship date), base tier 0."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    tier = F.when(F.col("l_quantity") <= 10, 0.0).otherwise(F.col("l_quantity"))
    return lineitem.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("supplier"), F.to_date("l_shipdate").alias("price_date"), tier.alias("min_qty"), price.alias("price"), F.col("l_orderkey").alias("offer"), F.col("l_linenumber").alias("line"))


#: The same stand-ins as SQL, for the oracles.
SQL = {
    "requirement": "requirement AS (SELECT l_orderkey AS tender_id, l_linenumber AS line, min(l_partkey) AS part, (['" + "','".join(CATEGORIES) + "'])[(min(l_partkey) % 12 + 1)::INT] AS category, l_linenumber <= 4 AS mandatory, CASE WHEN min(l_partkey) % 6 = 0 THEN 'HARD_GATE' ELSE 'QUALIFICATION' END AS requirement_type FROM lineitem GROUP BY 1, 2)",
    "evidence": f"evidence AS (SELECT l_orderkey AS tender_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' AND l_suppkey % 8 = 0 THEN 'FAIL' WHEN l_returnflag = 'N' AND l_suppkey % 9 = 0 THEN 'REVIEW' ELSE 'PASS' END AS status, l_suppkey % 20 = 0 AS mismatch, l_shipdate::DATE < DATE '{AS_OF}' AS expired FROM lineitem WHERE l_partkey % 11 <> 0)",
    "status": """status AS (SELECT r.*, coalesce(e.n, 0) AS n_evidence, CASE WHEN coalesce(e.ok, 0) = 0 THEN 'MISSING_EVIDENCE' WHEN e.old > 0 THEN 'REVIEW' WHEN e.f > 0 AND e.p > 0 THEN 'REVIEW' WHEN e.r > 0 AND e.f + e.p > 0 THEN 'REVIEW' WHEN e.f > 0 THEN 'FAIL' WHEN e.r > 0 THEN 'REVIEW' ELSE 'PASS' END AS status
FROM requirement r LEFT JOIN (SELECT tender_id, line, count(*) AS n, count(*) FILTER (NOT mismatch) AS ok, count(*) FILTER (NOT mismatch AND expired) AS old, count(*) FILTER (NOT mismatch AND status = 'FAIL') AS f, count(*) FILTER (NOT mismatch AND status = 'PASS') AS p, count(*) FILTER (NOT mismatch AND status = 'REVIEW') AS r FROM evidence GROUP BY 1, 2) e USING (tender_id, line))""",
    "decision": """decision AS (SELECT o.o_orderkey AS tender_id, coalesce(gate_fail, 0) AS gate_fail, coalesce(contradicted, 0) AS contradicted, coalesce(gate_missing, 0) AS gate_missing, coalesce(gate_review, 0) AS gate_review, coalesce(gaps, 0) AS gaps, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS high_risks
FROM orders o LEFT JOIN (SELECT tender_id, count(*) FILTER (mandatory AND requirement_type = 'HARD_GATE' AND status = 'FAIL') AS gate_fail, count(*) FILTER (mandatory AND requirement_type <> 'HARD_GATE' AND status = 'FAIL') AS contradicted, count(*) FILTER (mandatory AND requirement_type = 'HARD_GATE' AND status = 'MISSING_EVIDENCE') AS gate_missing, count(*) FILTER (mandatory AND requirement_type = 'HARD_GATE' AND status = 'REVIEW') AS gate_review, count(*) FILTER (mandatory AND requirement_type <> 'HARD_GATE' AND status IN ('MISSING_EVIDENCE', 'REVIEW')) AS gaps FROM status GROUP BY 1) s ON s.tender_id = o.o_orderkey),
ruled AS (SELECT *, CASE WHEN gate_fail > 0 THEN 'HARD_GATE_FAIL' WHEN contradicted > 0 THEN 'MANDATORY_REQUIREMENT_CONTRADICTED' WHEN gate_missing > 0 THEN 'MANDATORY_GATE_MISSING' WHEN gate_review > 0 THEN 'MANDATORY_GATE_REVIEW' WHEN gaps > 0 THEN 'EXPERIENCE_EVIDENCE_MISSING' WHEN high_risks > 0 THEN 'COMMERCIAL_RISK_REVIEW' ELSE 'ALL_MANDATORY_PASS' END AS rule FROM decision)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
