"""Tables inside page text: bills of quantities, price lists, sheets, label and value pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that head the columns of a bill, and of a price list.
BILL = {"item": ("item", "item no", "no"), "description": ("description", "item description", "material"), "unit": ("unit", "uom"), "quantity": ("quantity", "qty")}
PRICE_LIST = {"description": ("description", "material", "item description", "product"), "unit": ("unit", "uom"), "price": ("price", "unit price", "rate", "net price"), "currency": ("currency", "cur"), "min_qty": ("min qty", "minimum quantity", "min quantity", "from qty", "moq")}


def to_number(text: Column) -> Column:
    """Number with thousands separators; null for anything else."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(bare.rlike(r"^\d+(\.\d+)?$"), bare.cast("double"))


def rows_under_header(pages: DataFrame, names: dict[str, tuple[str, ...]], needed: tuple[str, ...], repeats: bool) -> DataFrame:
    """document, page, row and a column for each of names, from the lines of pages with two | or more.

    A line that names the needed columns is a header. With repeats the last header above a row is in effect, else
    the first of the page; rows above any header are left out. The window runs within a page.
    """
    lines = pages.select("document", "page", F.posexplode(F.filter(F.split("text", "\n"), lambda s: F.length(F.regexp_replace(s, r"[^|]", "")) >= 2)).alias("pos", "line"))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    low = F.transform(cells, lambda c: F.lower(c))
    at = {slot: F.array_min(F.array(*[F.nullif(F.array_position(low, n), F.lit(0)) for n in known])) for slot, known in names.items()}
    is_header = F.lit(True)
    for slot in needed:
        is_header = is_header & at[slot].isNotNull()
    lines = lines.select("document", "page", "pos", cells.alias("cells"), F.when(is_header, F.struct(*[v.alias(k) for k, v in at.items()])).alias("header"))
    order = Window.partitionBy("document", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pick = F.last if repeats else F.first
    lines = lines.withColumn("use", pick("header", ignorenulls=True).over(order)).where("use is not null")
    lines = lines.where("header is null") if repeats else lines.where("header is null or header is distinct from use")
    return lines.select("document", "page", (F.col("pos") + 1).alias("row"), *[F.coalesce(F.get("cells", F.col(f"use.{k}").cast("int") - 1), F.lit("")).alias(k) for k in names])


def boq_lines(pages: DataFrame) -> DataFrame:
    """Bill rows with a description of four characters or more and a positive quantity; km count as m."""
    rows = rows_under_header(pages, BILL, ("description", "quantity"), repeats=True).withColumn("q", to_number(F.col("quantity")))
    km = F.lower("unit") == "km"
    rows = rows.where("q > 0 and length(description) >= 4")
    return rows.select("document", "page", "row", F.nullif("item", F.lit("")).alias("item"), F.substring("description", 1, 300).alias("description"), F.when(km, "m").otherwise(F.lower("unit")).alias("unit"), F.when(km, F.col("q") * 1000).otherwise(F.col("q")).alias("quantity"))


def price_rows(pages: DataFrame, currency: str) -> DataFrame:
    """Rows of price lists with a positive price; a price per km becomes one per m, currency stands in where none is given."""
    rows = rows_under_header(pages, PRICE_LIST, ("description", "price"), repeats=False).withColumn("p", to_number(F.col("price")))
    km = F.lower("unit") == "km"
    named = F.substring(F.upper(F.trim(F.coalesce(F.nullif("currency", F.lit("")), F.lit(currency)))), 1, 3)
    rows = rows.where("p > 0 and description <> ''")
    return rows.select("document", "page", "row", "description", F.when(km, "m").otherwise(F.lower("unit")).alias("unit"), F.when(km, F.col("p") / 1000).otherwise(F.col("p")).alias("price"), named.alias("currency"), F.coalesce(to_number(F.col("min_qty")), F.lit(0.0)).alias("min_qty"))


def sheet_rows(sheets: DataFrame, separator: str = ",", most: int = 5000, width: int = 500) -> DataFrame:
    """document, row, name, cell: every cell of delimited sheets (document, text).

    The first row that is not blank names the columns, col_n where it has no name; most rows a sheet and width
    characters a cell are the format's own limits.
    """
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(F.replace(s, F.lit(separator), F.lit(""))) != "")
    cut = lambda line: F.transform(F.split(line, re.escape(separator)), lambda c: F.substring(F.trim(c), 1, width))
    rows = sheets.select("document", lines.alias("lines")).where(F.size("lines") > 1)
    head = F.transform(cut(F.get("lines", F.lit(0))), lambda c, i: F.when(c == "", F.concat(F.lit("col_"), i + 1)).otherwise(c))
    rows = rows.select("document", head.alias("head"), F.posexplode(F.slice("lines", F.lit(2), F.lit(most))).alias("pos", "line"))
    cells = F.transform("head", lambda name, i: F.struct(name.alias("name"), F.coalesce(F.get(cut(F.col("line")), i), F.lit("")).alias("cell")))
    return rows.select("document", (F.col("pos") + 1).alias("row"), F.inline(cells))


def label_values(lines: DataFrame, labels: tuple[str, ...], within: int = 30) -> DataFrame:
    """document, page, label, value: for each label line of lines (document, page, pos, line) the next line, if it comes within so many."""
    order = Window.partitionBy("document", "page").orderBy("pos")
    rows = lines.withColumns({"value": F.lead("line").over(order), "at": F.lead("pos").over(order)})
    hit = F.lower("line").isin(*[x.lower() for x in labels]) & (F.col("at") - F.col("pos") <= within)
    return rows.where(hit).select("document", "page", F.lower("line").alias("label"), "value")


def read_plan(files: DataFrame, manifest: DataFrame, tools: str, patience: int = 2) -> DataFrame:
    """digest and READ or REUSE for files (document, content) against manifest (document, digest, tools, failed, failed_reads).

    A file of the same content is reused; after a failure only when the same tools failed alike patience times.
    """
    rows = files.select("document", F.sha1("content").alias("digest")).join(manifest.withColumnRenamed("digest", "known"), "document", "left")
    done = ~F.col("failed") | ((F.col("tools") == tools) & (F.col("failed_reads") >= patience))
    return rows.select("document", "digest", F.when(F.coalesce((F.col("known") == F.col("digest")) & done, F.lit(False)), "REUSE").otherwise("READ").alias("action"))


def commercial_slots(pages: DataFrame) -> DataFrame:
    """document, slot, value, page: the first page, in order, whose text states currency or validity."""
    slots = (("currency", F.regexp_extract("text", r"\b(SAR|USD|EGP|AED|EUR)\b", 1)), ("validity", F.regexp_extract("text", r"(?i)(valid[^.\n]{0,60}?\d+\s+days?)", 1)))
    long = pages.select("document", "page", F.inline(F.filter(F.array(*[F.struct(F.lit(n).alias("slot"), v.alias("value")) for n, v in slots]), lambda s: s["value"] != "")))
    return long.groupBy("document", "slot").agg(F.min_by("value", "page").alias("value"), F.min("page").alias("page"))


def eligibility(tenders: DataFrame, capability: dict) -> DataFrame:
    """tender_id, check, result (PASS, FAIL or UNCLEAR) of tenders (tender_id, work_type, kv, country, demanded) against a capability.

    Parts that the capability does not state are not checked; demanded certificates are checked where there are any.
    """
    known = lambda value, ok: F.when(value.isNull(), "UNCLEAR").when(ok, "PASS").otherwise("FAIL")
    checks = []
    if capability.get("work_types"):
        checks.append(("work_type", known(F.col("work_type"), F.col("work_type").isin(*capability["work_types"]))))
    if capability.get("max_kv"):
        checks.append(("voltage", known(F.col("kv"), F.col("kv") <= capability["max_kv"])))
    if capability.get("countries"):
        checks.append(("country", known(F.col("country"), F.col("country").isin(*capability["countries"]))))
    held = capability.get("certifications")
    lacks = F.size(F.array_except("demanded", F.array(*map(F.lit, held)))) > 0 if held else None
    checks.append(("certifications", F.when(F.size("demanded") > 0, F.when(lacks, "FAIL").otherwise("PASS") if held else F.lit("UNCLEAR"))))
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("check"), r.alias("result")) for n, r in checks]), lambda c: c["result"].isNotNull())
    return tenders.select("tender_id", F.inline(each))


def eligibility_score(checks: DataFrame) -> DataFrame:
    """Checks met, failed, unclear and the percentage met of each tender of eligibility()."""
    n = {name: F.count_if(F.col("result") == r) for name, r in (("met", "PASS"), ("failed", "FAIL"), ("unclear", "UNCLEAR"))}
    rows = checks.groupBy("tender_id").agg(*[c.alias(k) for k, c in n.items()], F.count(F.lit(1)).alias("total"))
    return rows.withColumn("percent", F.bround(100.0 * F.col("met") / F.col("total"), 0).cast("long"))


def certificate_demands(sentences: DataFrame, pattern: str, held: tuple[str, ...], optional: str = r"(?i)preferabl|optional|desirable", partner: str = r"(?i)manufacturer|subcontractor|supplier") -> DataFrame:
    """name, who, demands, optional, first_page, status of certificates named in sentences (document, page, sentence).

    who is partner where the sentence speaks of one; optional only if all its sentences say so.
    """
    rows = sentences.select("document", "page", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1)))).alias("name"))
    who = F.when(F.col("sentence").rlike(partner), "partner").otherwise("company")
    rows = rows.groupBy("name", who.alias("who")).agg(F.count(F.lit(1)).alias("demands"), F.bool_and(F.col("sentence").rlike(optional)).alias("optional"), F.min("page").alias("first_page"))
    return rows.withColumn("status", F.when(F.col("who") == "partner", "PARTNER_NEEDED").when(F.col("name").isin(*held), "HELD").otherwise("MISSING"))
