"""Bills of quantities in sheets of any layout: which row heads the columns, which column is what, and the line items under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the columns of a bill are called, in order; the header is among the first rows.
ALIASES = {
    "item": ("item", "no", "no.", "s.no", "sr", "s/n", "البند", "م"),
    "description": ("description", "desc", "details", "particulars", "الوصف", "البيان"),
    "unit": ("unit", "uom", "الوحدة"),
    "quantity": ("quantity", "qty", "amount", "الكمية"),
    "unit_price": ("unit price", "material unit price", "rate", "unit rate", "سعر الوحدة", "الفئة"),
    "total_price": ("total", "total price", "total material price", "amount total", "السعر الاجمالى", "الاجمالى", "الجملة"),
}
HEADER_ROWS, SHORT, LONG, LEAST = 11, 8, 20, 3
ARABIC = r"[؀-ۿ]+"


def slot(header: Column) -> Column:
    """What a column of that header holds, null if unknown: a whole alias or one of several words inside come first, then one at either end."""
    n = F.trim(F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"\s+", " "))
    whole = [F.when(n.isin(*known) | sum_or(*[n.contains(a) for a in known if " " in a]), F.lit(s)) for s, known in ALIASES.items()]
    ends = [F.when(sum_or(*[n.startswith(a + " ") | n.endswith(" " + a) for a in known if " " not in a]), F.lit(s)) for s, known in ALIASES.items()]
    return F.coalesce(*whole, *ends)


def sum_or(*tests: Column) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def bilingual(text: Column) -> tuple[Column, Column]:
    """The Latin part of a text, white space collapsed, and the Arabic one; either may be empty."""
    latin = F.trim(F.regexp_replace(F.regexp_replace(text, ARABIC, " "), r"\s+", " "))
    return latin, F.array_join(F.regexp_extract_all(text, F.lit(ARABIC), 0), " ")


def line_items(rows: DataFrame) -> DataFrame:
    """document, location (`sheet!Rn`), item, description, description_en, description_ar, unit, quantity, unit_price, total_price.

    rows: document, sheet, row (from 1), cells (array of strings). A sheet's header is the first of its first HEADER_ROWS rows
    that names a description and one more slot; a sheet without one gives nothing. Of several columns of one name the last counts.
    A description of under SHORT characters gives way to the longest cell of LONG or more, if there is one; one of under LEAST
    is no line item. Cells that are null, blank or missing are null, headers take part as they stand. Only header rows are
    brought to their sheet's rows, so a large sheet is never gathered.
    """
    named = F.lower(F.array_join("cells", "\u0001")).rlike("|".join(ALIASES["description"]))  # else no cell names a description, and none is tried
    slots = F.transform("cells", lambda c: slot(c))
    heads = rows.where((F.col("row") <= HEADER_ROWS) & named).select("document", "sheet", "row", "cells", F.explode(F.array(slots)).alias("slots"))
    heads = heads.where(F.array_contains(F.array_compact(F.col("slots")), "description") & (F.size(F.array_distinct(F.array_compact(F.col("slots")))) >= 2))
    keys = F.transform(F.arrays_zip("slots", "cells"), lambda x: F.coalesce(x["slots"], F.concat(F.lit("\u0001"), F.coalesce(x["cells"], F.lit("")))))
    heads = heads.groupBy("document", "sheet").agg(F.min_by(F.struct("row", keys.alias("keys")), "row").alias("head"))
    # once for a sheet: the last column of each slot, and which columns are the last of their name
    at = {s: F.size("head.keys") - F.nullif(F.array_position(F.reverse("head.keys"), s), F.lit(0)).cast("int") for s in ALIASES}
    last = F.transform("head.keys", lambda k, i: ~F.array_contains(F.slice("head.keys", i + 2, F.size("head.keys")), k))
    heads = heads.select("document", "sheet", F.col("head.row").alias("top"), last.alias("last"), *[c.alias(f"at_{s}") for s, c in at.items()])
    under = rows.join(heads, ["document", "sheet"]).where(F.col("row") > F.col("top"))
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    of = {s: strip(F.get("cells", F.col(f"at_{s}"))) for s in ALIASES}
    counted = F.transform("cells", lambda c, i: F.when(F.coalesce(F.get("last", i), F.lit(True)), F.struct(F.length(strip(c)).alias("n"), (-i).alias("at"), strip(c).alias("c"))))
    long = F.array_max(F.filter(counted, lambda x: x["n"] >= LONG))["c"]
    described = F.when(F.length(of["description"]) < SHORT, F.coalesce(long, of["description"])).otherwise(of["description"])
    location = F.concat("sheet", F.lit("!R"), "row").alias("location")
    # a column that a filter cannot be pushed below with all it is made of
    under = under.select("document", location, *[c.alias(s) for s, c in of.items() if s != "description"], F.explode(F.array(described)).alias("description")).where(F.length("description") >= LEAST)
    latin, arabic = bilingual(F.col("description"))
    some = lambda c: F.nullif(c, F.lit(""))
    return under.select("document", "location", some(F.col("item")).alias("item"), "description", some(latin).alias("description_en"), some(arabic).alias("description_ar"), *[some(F.col(s)).alias(s) for s in ("unit", "quantity", "unit_price", "total_price")])
