"""Terms of questions and document classes by hand."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import packs, questions

ASKED = {
    "What is the liquidated damages clause?": ({"liquidated", "damages", "clause", "delay", "penalty"}, {"liquidated damages", "damages clause", "delay penalty"}),
    "ما هي غرامة تأخير العقد": ({"غرامة", "تأخير", "العقد", "liquidated", "damages", "delay", "penalty", "penalties"}, {"غرامة تأخير", "تأخير العقد", "liquidated damages", "delay penalty"}),
    "and what of it?": (set(), set()),
    None: (set(), set()),
}


def test_terms(spark):
    rows = questions.terms(spark.createDataFrame(list(enumerate(ASKED)), "id long, question string")).collect()
    got = {i: ({r.term for r in rows if r.id == i and r.weight == 1.0}, {r.term for r in rows if r.id == i and r.weight == 2.5}) for i in range(len(ASKED))}
    assert got == dict(enumerate(ASKED.values()))
    assert len(rows) == len(set(rows))


def test_search_of_several_questions(spark):
    pages = [("a", 1, "Liquidated damages are limited to 10%. Short one. An insurance of the works is asked for;\n\nA cable of 220 kV is laid in trenches. " + "long " * 200), ("b", 2, None), ("b", 3, "The liquidated damages are not limited at all")]
    asked = [(1, "liquidated damages"), (2, "كابل"), (3, None), (4, "trenches of cable")]
    got = questions.search(spark.createDataFrame(pages, "document string, page int, text string"), spark.createDataFrame(asked, "id long, question string")).collect()
    assert [(r.id, r.nth, r.document, r.page, r.score) for r in sorted(got)] == [(1, 1, "a", 1, 5.0), (1, 2, "b", 3, 4.5), (4, 1, "a", 1, 2.5)]


@pytest.mark.parametrize(
    "name, page, want",
    [("Vol 1 Price.pdf", None, "BOQ"), ("a.pdf", "The voltage is", "TECHNICAL"), ("a.pdf", "x" * 500 + "voltage", "OTHER"), ("Consortium.pdf", None, "LEGAL"), ("plan.dwg", "", "DRAWING"), ("x.pdf", "Programme of works", "SCHEDULE"), ("addendum clarification.pdf", "", "CLARIFICATION"), (None, None, "OTHER")],
)
def test_document_class(spark, name, page, want):
    rows = spark.createDataFrame([(name, page)], "name string, page string")
    assert rows.select(packs.document_class(F.col("name"), F.col("page"))).first()[0] == want
