"""Expected results of the decision rules and small text cases."""

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import decisions, materials, similarity

REQ = "tender_id string, line int, category string, mandatory boolean, requirement_type string"
EV = "tender_id string, line int, status string, mismatch boolean, expired boolean"


def decide(spark, rows):
    """rows: (category, kind, status or None)"""
    req = spark.createDataFrame([("t", i, c, True, k) for i, (c, k, _) in enumerate(rows)], REQ)
    ev = spark.createDataFrame([("t", i, s, False, False) for i, (_, _, s) in enumerate(rows) if s], EV)
    tenders = spark.createDataFrame([("t",)], "tender_id string")
    none = spark.createDataFrame([], "tender_id string, severity string")
    return decisions.tender_decision(tenders, decisions.requirement_status(req, ev), none).first()


GATES = [("LEGAL", "HARD_GATE", "PASS"), ("EXPERIENCE", "HARD_GATE", "PASS")]


def test_decision_rules(spark):
    r = decide(spark, [*GATES, ("COMMERCIAL", "QUALIFICATION", "PASS")])
    assert (r.decision, r.confidence, r.rule) == ("BID", "HIGH", "ALL_MANDATORY_PASS")
    r = decide(spark, [*GATES, *[("PERSONNEL", "QUALIFICATION", None)] * 7, ("HSE", "QUALIFICATION", "FAIL")])
    assert (r.decision, r.contradicted, r.gate_fail) == ("REVIEW", 1, 0)
    assert len(r.blockers.split("; ")) == 6 and r.blockers.startswith("HSE/9 [CONTRADICTED]")
    assert decide(spark, [*GATES, ("LEGAL", "QUALIFICATION", None)]).rule == "EXPERIENCE_EVIDENCE_MISSING"
    assert decide(spark, [("LEGAL", "HARD_GATE", "FAIL"), ("HSE", "QUALIFICATION", "FAIL")]).decision == "NO_BID"


def test_status_precedence(spark):
    req = spark.createDataFrame([("t", i, "X", True, "HARD_GATE") for i in range(6)], REQ)
    ev = spark.createDataFrame([("t", 0, "PASS", True, False), ("t", 1, "PASS", False, True), ("t", 2, "PASS", False, False), ("t", 2, "FAIL", False, False), ("t", 3, "FAIL", False, False), ("t", 4, "PASS", False, False)], EV)
    got = {r.line: r.status for r in decisions.requirement_status(req, ev).collect()}
    assert got == {0: "MISSING_EVIDENCE", 1: "REVIEW", 2: "REVIEW", 3: "FAIL", 4: "PASS", 5: "MISSING_EVIDENCE"}


def test_scores(spark):
    rows = [("a", 80.0, 40.0), ("a", 50.0, 20.0), ("a", 100.0, 15.0), ("a", 60.0, 25.0), ("b", 80.0, 40.0), ("b", None, 20.0), ("b", None, 15.0), ("b", 40.0, 25.0), ("c", None, 40.0)]
    df = spark.createDataFrame([(t, v, w, False) for t, v, w in rows], "tender_id string, value double, weight double, hard_fail boolean")
    got = {r.tender_id: (r.score, r.band) for r in decisions.weighted_score(df).collect()}
    assert got == {"a": (72, "GO"), "b": (65, "REVIEW"), "c": (None, None)}


def test_quotations(spark):
    quotes = [("DesertCool", 1.94e6, 11.0, 94.0, 60.0), ("Najd", 2.08e6, 12.0, 88.0, 45.0), ("GulfAir", 1.87e6, 14.0, 71.0, 90.0), ("Rawafid", 2.21e6, 10.0, 90.0, 30.0), ("Cheap", 1.2e6, 9.0, 50.0, 90.0)]
    df = spark.createDataFrame([("r", c, i, *rest) for i, (c, *rest) in enumerate(quotes)], "rfq string, contractor string, offer int, price double, duration double, fit double, terms double")
    got = {r.contractor: (r.eligible, r.best) for r in materials.score_quotations(df).collect()}
    assert got["Cheap"] == (False, False) and [c for c, (_, best) in got.items() if best] == ["DesertCool"]


def test_text(spark):
    df = spark.createDataFrame([("  THE transformer must be 220kV GIS type! ", "twenty-six")], "t string, n string")
    r = df.select(T.normal_form(F.col("t")).alias("form"), T.number_of(F.col("n")).alias("n"), T.signals(F.col("t")).alias("s"), F.size(T.sentences(F.lit("One. Two\nthree; Four"))).alias("k")).first()
    assert (r.form, r.n, r.s, r.k) == ("the transformer must be 220kv gis type", 26, ["TECHNICAL"], 4)


def test_clusters_and_leaders(spark):
    nodes = spark.range(1, 7).select("id")
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert {r.id: r.cluster for r in similarity.clusters(nodes, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert {r.id: r.leader for r in similarity.leaders(nodes, links).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
