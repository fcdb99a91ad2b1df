"""Bill sheets by hand."""

import pytest

from paperloom.operators import bills

SHEETS = {
    # sheet: rows, then (location, item, description, arabic, unit, quantity, unit price, total)
    "plain": ([["No.", "Goods description", "UOM", "Qty", "Unit Price", "Total"], ["1", "XLPE cable 4x16", "m", "20", "3.5", "70"]], [("plain!R2", "1", "XLPE cable 4x16", None, "m", "20", "3.5", "70")]),
    "titles": ([["Bill of quantities"], [None, ""], ["البند", "الوصف", "الوحدة", "الكمية"], ["1", "Cable كابل نحاس four core", " m ", None]], [("titles!R4", "1", "Cable كابل نحاس four core", "كابل نحاس", "m", None, None, None)]),
    "price first": ([["Particulars of work", "Material unit price SAR", "Rate of progress", "unit"], ["Steel towers", "12", "fast", "t"]], [("price first!R2", None, "Steel towers", None, "t", None, "fast", None)]),
    "two units": ([["description", "unit", "unit"], ["Concrete works", "a", "b"]], [("two units!R2", None, "Concrete works", None, "b", None, None, None)]),
    "short": ([["desc", "qty", "remarks", "notes"], ["pos", "3", "a long remark on this line", "the longest remark of all here"], ["ab", "1", "x", "y"], ["", "2", "", ""], ["pile", "2"]], [("short!R2", None, "the longest remark of all here", None, None, "3", None, None), ("short!R5", None, "pile", None, None, "2", None, None)]),
    "extra cells": ([["desc", "qty"], ["x", "3", "a cell that has no header but is long"]], [("extra cells!R2", None, "a cell that has no header but is long", None, None, "3", None, None)]),
    "no header": ([["1", "Cable"], ["2", "Wire"]], []),
    "only description": ([["Description", "Remarks"], ["Cable of copper", "x"]], []),
    "late header": ([["x"]] * 11 + [["description", "qty"], ["Cable of copper", "3"]], []),
    "eleventh": ([["x"]] * 10 + [["description", "qty"], ["Cable of copper", "3"]], [("eleventh!R12", None, "Cable of copper", None, None, "3", None, None)]),
    "empty": ([], []),
}


@pytest.mark.parametrize("parts", [1, 5])
def test_line_items(spark, parts):
    rows = [("d.xlsx", s, i + 1, cells) for s, (held, _) in SHEETS.items() for i, cells in enumerate(held)]
    got = bills.line_items(spark.createDataFrame(rows, "document string, sheet string, row int, cells array<string>").repartition(parts)).drop("description_en").collect()
    assert sorted(map(str, (tuple(r)[1:] for r in got))) == sorted(str(w) for _, want in SHEETS.values() for w in want)


def test_no_sheets(spark):
    assert bills.line_items(spark.createDataFrame([], "document string, sheet string, row int, cells array<string>")).count() == 0


def test_a_description_is_made_once(spark):
    """Spark pushes a filter on it down with all it is made of, unless it is held."""
    rows = spark.createDataFrame([("d", "s", 1, ["Item", "Description"]), ("d", "s", 2, ["1", "steel towers"])], "document string, sheet string, row int, cells array<string>")
    items = bills.line_items(rows)
    assert [r.description for r in items.collect()] == ["steel towers"]
    assert items._jdf.queryExecution().optimizedPlan().toString().count("array_max") == 1
