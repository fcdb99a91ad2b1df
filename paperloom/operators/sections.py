"""Document sections from headings: split, discipline, work packages, pages of a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R


def headings(pages: DataFrame) -> DataFrame:
    """document, page, line, title, numbered, key: headings of the first lines of pages (document, page, text[, ocr]).

    A heading opens a part (SECTION 4, ANNEX B) or is a short numbered title in capitals, which scanned pages do not
    give; lines of a table of contents are none. Headings alike in key are one heading.
    """
    ocr = F.col("ocr") if "ocr" in pages.columns else F.lit(False)
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), 1, R.HEAD_LINES)
    rows = pages.select("document", "page", ocr.alias("ocr"), F.posexplode(lines).alias("line", "body"))
    rows = rows.where((F.length("body") <= R.HEAD_CHARS) & ~F.col("body").rlike(R.CONTENTS))
    part = F.when(~F.col("body").rlike(R.PART_CODE), F.regexp_extract("body", R.PART_HEAD, 1)).otherwise("")
    number, name = F.regexp_extract("body", R.NUMBERED, 1), F.regexp_extract("body", R.NUMBERED, 2)
    rows = rows.select("document", "page", "ocr", "line", F.trim(F.regexp_replace(part, r"\s+", " ")).alias("part"), number.alias("number"), F.trim(F.regexp_replace(name, r"\s+", " ")).alias("name"))
    short = (F.length(F.regexp_replace("name", r"[^\p{L}]", "")) >= 5) & (F.size(F.split("name", " ")) <= 8) & ~F.col("name").rlike(R.NOTE)
    numbered = (F.col("part") == "") & (F.col("number") != "") & (F.expr("try_cast(number as int)") <= 30) & short & ~F.coalesce("ocr", F.lit(False))
    rows = rows.where((F.col("part") != "") | numbered).withColumn("numbered", F.col("part") == "")
    title = F.when(F.col("numbered"), F.concat("number", F.lit(". "), F.initcap("name"))).otherwise(F.col("part"))
    rows = rows.withColumn("title", title)
    words = F.filter(F.split(F.replace(F.lower("title"), F.lit(","), F.lit(" ")), " +"), lambda w: w != "")
    return rows.select("document", "page", "line", "title", "numbered", F.when(F.col("numbered"), F.lower("title")).otherwise(F.array_join(F.slice(words, 1, 2), " ")).alias("key"))


def split_sections(pages: DataFrame, most: int = R.MOST_SECTIONS) -> DataFrame:
    """document, title, page_from, page_to, discipline: sections of pages (document, page, text).

    The first heading of each key counts. Further headings of a page fold into its first as (+n). Numbered titles whose
    words recur in the document are table heads and go. Pages before the first section are front matter; a document
    without headings is one section. Beyond most sections only parts and numbered titles stay, then only parts.
    """
    document = Window.partitionBy("document")
    found = headings(pages)
    first = F.row_number().over(Window.partitionBy("document", "key").orderBy("page", "line"))
    found = found.withColumn("nth", first).where("nth = 1").drop("nth")
    found = found.groupBy("document", "page").agg(F.min(F.struct("line", "title", "numbered")).alias("h"), (F.count(F.lit(1)) - 1).alias("more"))
    found = found.select("document", F.col("page").alias("page_from"), "h.title", "h.numbered", "more")
    bare = F.lower(F.regexp_replace("title", r"^\d+\. ", ""))
    recurs = F.count(F.lit(1)).over(Window.partitionBy("document", "numbered", bare))
    found = found.withColumn("recurs", recurs).where("not numbered or recurs = 1").drop("recurs")
    spans = pages.groupBy("document").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("pages"))
    starts = spans.join(found.groupBy("document").agg(F.min("page_from").alias("at")), "document", "left")
    whole = F.regexp_replace("document", r"\.[^.]*$", "")
    lead = starts.where("at is null or at > first").select("document", F.col("first").alias("page_from"), F.when(F.col("at").isNull(), whole).otherwise("Front matter").alias("title"), F.lit(False).alias("numbered"), F.lit(0).cast("long").alias("more"))
    rows = lead.unionByName(found)
    is_part = F.col("title").rlike(R.PART_HEAD) & ~F.col("title").rlike(R.PART_CODE)
    opens = F.row_number().over(document.orderBy("page_from")) == 1
    rows = rows.withColumns({"opens": opens, "n": F.count(F.lit(1)).over(document)})
    rows = rows.withColumn("level", F.when(F.col("opens") | is_part, 2).when(F.col("numbered"), 1).otherwise(0))
    rows = rows.withColumn("top", F.count_if(F.col("level") > 0).over(document))
    rows = rows.where((F.col("n") <= most) | (F.col("level") > F.when(F.col("top") > most, 1).otherwise(0)))
    rows = rows.withColumn("nth", F.row_number().over(document.orderBy("page_from"))).where(F.col("nth") <= most)
    rows = rows.withColumn("after", F.lead("page_from").over(document.orderBy("page_from"))).join(spans, "document")
    alone = (F.col("pages") == 1) & (F.count(F.lit(1)).over(document) == 1)
    rows = rows.withColumn("page_to", F.greatest(F.coalesce(F.col("after") - 1, "last"), "page_from"))
    rows = rows.withColumn("title", F.when(alone, whole).otherwise(F.substring("title", 1, 160))).withColumn("more", F.when(alone, 0).otherwise(F.col("more")))
    return _with_discipline(rows.select("document", "title", "page_from", "page_to", "more"), pages)


def pages_of(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the page_from of the section they lie in: the last that starts at or before them."""
    marks = pages.select("document", "page", F.lit(None).cast("long").alias("start")).unionByName(sections.select("document", F.col("page_from").alias("page"), F.col("page_from").cast("long").alias("start")))
    at = Window.partitionBy("document").orderBy("page", F.col("start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("page_from", F.last("start", ignorenulls=True).over(at)).where("start is null").drop("start")


def _with_discipline(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """The body is the first 3000 characters of each page of a section, as long as 6000 are not reached."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, 3000)
    bodies = pages_of(sections, pages).join(pages.select("document", "page", text.alias("body")), ["document", "page"])
    before = Window.partitionBy("document", "page_from").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    bodies = bodies.withColumn("so_far", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0))).where("so_far < 6000")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "")
    rows = sections.join(bodies.groupBy("document", "page_from").agg(joined.alias("body")), ["document", "page_from"], "left")
    rows = rows.withColumn("discipline", R.discipline(F.col("title"), F.col("body")))
    title = F.when(F.col("more") > 0, F.concat("title", F.lit(" (+"), F.col("more").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.select("document", title.alias("title"), "page_from", "page_to", "discipline")


def work_packages(sections: DataFrame) -> DataFrame:
    """Sections and pages of each technical discipline."""
    rows = sections.where(~F.col("discipline").isin(*R.NON_TECHNICAL))
    return rows.groupBy("discipline").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("page_to") - F.col("page_from") + 1).alias("pages"))
