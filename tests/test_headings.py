"""References, their own headings and what a package lacks, by hand."""

import pytest

from paperloom.operators import headings

CASES = [
    # text, (reference, own heading, not applicable) of each reference that opens a unit
    ("APPENDIX VII\nTechnical Schedules\nThe works", [("APPENDIX VII", True, False)]),
    ("APPENDIX\nV\nGeneral", [("APPENDIX V", True, False)]),
    ("ANNEXURE-II Template Administration", [("ANNEX II", True, False)]),
    ("in accordance with\nFORM 3 Bid Letter", [("FORM 3", False, False)]),
    ("Works and\nExhibit B, as signed", [("EXHIBIT B", False, False)]),
    ("Appendix 7 and this part shall be applied", [("APPENDIX 7", False, False)]),
    ("see Appendix 7 for details", []),
    ("a | b | c | d\nAPPENDIX 7 TO MAIN SCOPE", [("APPENDIX 7", True, False)]),
    ("a | b | c | d\nAPPENDIX VII TO BE COMPLETED", [("APPENDIX VII", False, False)]),
    ("a | b | c | d\nAPPENDIX 7\nTO\nMAIN", [("APPENDIX 7", True, False)]),
    ("a | b | c | d\nAPPENDIX 7 Title", [("APPENDIX 7", False, False)]),
    ("ANNEX A General\nANNEX B-2\nNOT APPLICABLE\nANNEX D Drawings (N/A)", [("ANNEX A", False, False), ("ANNEX B-2", False, True), ("ANNEX D", False, True)]),
    ("ANNEX A General\nANNEX B Drawings\nmore\nN/A", [("ANNEX A", False, False), ("ANNEX B", False, False)]),
    ("rectangular form R+jX", []),
    ("form V is prose", []),
    ("Appendix shall apply", []),
    ("LIST OF ANNEXURES", []),
    ("Form IC or FORM 7x", []),
    ("FORM 12.3-1A.\nTitle", [("FORM 12.3-1A", False, False)]),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize("n", [1, 3])
def test_own_headings(spark, n):
    rows = spark.createDataFrame([("d", i, t) for i, (t, _) in enumerate(CASES)], "document string, page int, text string").repartition(n)
    got = {}
    for r in headings.headings(rows).collect():
        got.setdefault(r.page, []).append((r.reference, r.own_heading, r.not_applicable))
    assert {i: sorted(want) for i, (_, want) in enumerate(CASES) if want} == {i: sorted(v) for i, v in got.items()}


def test_absent_documents(spark):
    pages = [("a.pdf", 1, "See FORM 3, Annexure C and Appendix 7; FORM 3 again"), ("a.pdf", 2, "APPENDIX 7\nSchedules"), ("b.pdf", 1, "FORM 3 is to be filled in. FORM 3"), ("b.pdf", 2, "ANNEX E General\nANNEX C\nNOT APPLICABLE\nANNEX F Other"), ("b.pdf", 3, "Exhibit Q. FORM 9")]
    got = headings.absent_documents(spark.createDataFrame(pages, "document string, page int, text string"), spark.createDataFrame([("bid_exhibit_q.xlsx",)], "filename string"))
    assert {r.reference: (r.mentions, r.evidence) for r in got.collect()} == {
        "FORM 3": (4, "a.pdf#p1, a.pdf#p1, b.pdf#p1"),
        "FORM 9": (1, "b.pdf#p3"),
        "ANNEX E": (1, "b.pdf#p2"),
        "ANNEX F": (1, "b.pdf#p2"),
    }
    assert headings.absent_documents(spark.createDataFrame([], "document string, page int, text string"), spark.createDataFrame([], "filename string")).count() == 0


def test_a_page_is_marked_once(spark):
    pages = spark.createDataFrame([("d", 1, "ANNEX A\n" + "line\n" * 20 + "FORM 2 | and FORM 3")], "document string, page long, text string")
    rows = headings.headings(pages)
    assert [(r.reference, r.own_heading) for r in rows.collect()] == [("ANNEX A", False), ("FORM 2", False)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(coalesce(text") == 1
