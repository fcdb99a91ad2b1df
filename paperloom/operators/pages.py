"""Page structure: repeated lines, headings, sections, page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def lines(pages: DataFrame) -> DataFrame:
    """document, page, pos, line of every line that is not blank."""
    rows = pages.select("document", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def repeated_lines(rows: DataFrame, least: int = 3, share: float = 0.3, pages: int = 4) -> DataFrame:
    """Lines of lines() on at least max(least, share of its pages) pages of a document of enough pages."""
    total = rows.groupBy("document").agg(F.countDistinct("page").alias("pages"))
    per = rows.groupBy("document", "line").agg(F.countDistinct("page").alias("on_pages"))
    return per.join(total, "document").where((F.col("pages") >= pages) & (F.col("on_pages") >= F.greatest(F.lit(float(least)), F.col("pages") * share)))


def heading_in_effect(rows: DataFrame) -> DataFrame:
    """For each page of lines() the last heading at its end; null before the first."""
    heading = F.regexp_extract("line", T.HEADING, 1)
    per = rows.groupBy("document", "page").agg(F.max_by(F.when(heading != "", heading), F.when(heading != "", F.col("pos"))).alias("own"))
    order = Window.partitionBy("document").orderBy("page")
    return per.select("document", "page", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("heading"))


def section_ranges(rows: DataFrame) -> DataFrame:
    """Sections of lines(): a title's first page to the page before the next title's, at least one page."""
    heading = F.regexp_extract("line", T.HEADING, 1)
    titles = rows.withColumn("title", heading).where("title <> ''").groupBy("document", "title").agg(F.min("page").alias("from"))
    ends = rows.groupBy("document").agg(F.max("page").alias("last"))
    following = F.lead("from").over(Window.partitionBy("document").orderBy("from", "title"))
    return titles.join(ends, "document").select("document", "title", "from", F.greatest(F.coalesce(following - 1, F.col("last")), F.col("from")).alias("to"))


def page_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """Contiguous ranges of page numbers within keys."""
    numbered = rows.select(*keys, "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    return numbered.withColumn("island", island).groupBy(*keys, "island").agg(F.min("page").alias("from"), F.max("page").alias("to"), F.count(F.lit(1)).alias("pages")).drop("island")
