"""Facts in page text, and checks across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def _all(pattern: str, *groups: int) -> Column:
    """Array of structs g0, g1, ... of the groups of all matches."""
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in groups]
    return F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)])


def facts(pages: DataFrame) -> DataFrame:
    """document, page, fact, value, quote: every fact of every sentence without a word that says it is none; periods in the fact's unit."""
    said = F.filter(T.sentences(F.col("text"))["sentence"], lambda x: x.rlike("[0-9]") & x.rlike(T.FACT_ANCHOR))  # most sentences have no digit
    rows = pages.select("document", "page", F.explode_outer(said).alias("text")).where(~F.col("text").rlike(T.FACT_SKIP))  # outer: else sentences are split twice, to see whether there are any
    each = [F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("v"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("u")), _named(f)) for f, _, p in T.FACTS]
    return rows.select("document", "page", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300).alias("quote"), F.inline_outer(F.concat(*each))).where("fact is not null").select("document", "page", "fact", "value", "quote")


def _named(fact: str):
    def of(x: Column) -> Column:
        factor = F.lit(1)
        for unit, n in T.FACT_UNITS:
            factor = F.when(F.lower(x["u"]) == unit, n).otherwise(factor) if fact == "completion" and unit != "years" or fact == "warranty" and unit == "years" else factor
        return F.struct(F.lit(fact).alias("fact"), (x["v"].cast("double") * factor).alias("value"))

    return of


def fact_conflicts(found: DataFrame) -> DataFrame:
    """Values of facts that have two values or more in two documents or more: documents, first page and its quote."""
    first = F.min(F.struct("page", "document", "quote")).alias("f")
    per = found.groupBy("fact", "value").agg(F.countDistinct("document").alias("documents"), first, F.min("document").alias("low"), F.max("document").alias("high"))
    of_fact = Window.partitionBy("fact")  # a row for each value of a fact, numbers of up to four digits
    values, several = F.count(F.lit(1)).over(of_fact) > 1, F.min("low").over(of_fact) != F.max("high").over(of_fact)
    per = per.withColumn("kept", values & several).where("kept")
    return per.select("fact", "value", "documents", F.col("f.page").alias("first_page"), F.col("f.quote").alias("quote"))


def words_vs_digits(pages: DataFrame) -> DataFrame:
    """Number words whose digits in brackets disagree, where either has a unit; of one quote one, on the first page."""
    rows = pages.select("document", "page", F.explode(T.sentences(F.col("text"))["sentence"]).alias("text"))
    rows = rows.select("document", "page", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300).alias("quote"), F.inline(_all(T.NUMBER_WORDS, 1, 2, 3, 4)))
    rows = rows.withColumn("number", T.number_of(F.col("g0"))).withColumn("digits", F.col("g2").cast("int"))
    rows = rows.where("number <> digits and (g1 <> '' or g3 <> '')").groupBy("quote").agg(F.min(F.struct("page", "document", F.lower("g0").alias("words"), "number", "digits")).alias("f"))
    return rows.select("f.document", "f.page", "f.words", "f.number", "f.digits", "quote")


def dates(pages: DataFrame, most: int = 3) -> DataFrame:
    """Up to most date tokens of a page with a possible day and month, in order."""
    rows = pages.select("document", "page", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(T.DATE), F.lit(1)), _possible)).alias("n", "date"))
    return rows.where(F.col("n") < most)


def _possible(date: Column) -> Column:
    parts = F.split(date, "[/-]")
    return parts[0].cast("int").between(1, 31) & parts[1].cast("int").between(1, 12)


def money(pages: DataFrame) -> DataFrame:
    """Currency and amount of every money expression."""
    rows = pages.select("document", "page", F.inline(_all(T.MONEY, 1, 2)))
    return rows.select("document", "page", F.col("g0").alias("currency"), F.regexp_replace("g1", ",", "").cast("double").alias("amount"))


def schedule(pages: DataFrame) -> DataFrame:
    """Relative periods: duration in ISO form and the word they run from."""
    rows = pages.select("document", "page", F.inline(_all(T.RELATIVE, 1, 2, 4)))
    return rows.select("document", "page", T.iso_duration(F.col("g0"), F.col("g1")).alias("duration"), F.lower("g2").alias("anchor"))


def references(pages: DataFrame) -> DataFrame:
    """References to forms, annexes and the like; ANNEXURE counts as ANNEX."""
    rows = pages.select("document", "page", F.inline(_all(T.REFERENCE, 1, 2)))
    family = F.regexp_replace(F.upper("g0"), "ANNEXURE", "ANNEX")
    return rows.select("document", "page", F.concat(family, F.lit(" "), F.col("g1")).alias("reference"))


def absent_references(found: DataFrame, present: DataFrame) -> DataFrame:
    """References (reference) that no document of present holds, with pages and first page."""
    missing = found.join(present.select("reference").distinct(), "reference", "left_anti")
    return missing.groupBy("reference").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("first_page"))


def ambiguities(sentences: DataFrame) -> DataFrame:
    """document, page, kind: missing-value, unclear-date-anchor or unstated-obligation, one row each."""
    low = F.col("sentence")
    kinds = F.array_compact(F.array(F.when(low.rlike(T.TBD), F.lit("missing-value")), F.when(low.rlike(T.RELATIVE), F.lit("unclear-date-anchor")), F.when(low.rlike(T.OBLIGATION) & (F.col("signals") == ""), F.lit("unclear-applicability"))))
    return sentences.select("document", "page", F.explode(kinds).alias("kind"))


def materials(pages: DataFrame) -> DataFrame:
    """Delimited lines of pages as materials: family, size, kV, unit, quantity (km as m), key; null key without a family."""
    rows = pages.select("document", "page", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.regexp_replace("line", r"[^|]", "")) >= 2)
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    rows = rows.select("document", "page", cells[0].alias("description"), F.lower(cells[1]).alias("unit"), F.expr("try_cast(replace(split(line, '[|]')[2], ',', '') as double)").alias("quantity"))
    size = F.regexp_extract("description", r"(?i)(\d{1,2}\s*[x×]\s*\d{1,4}(?:\.\d)?)", 1)
    kv = F.regexp_extract("description", r"(?i)(\d{1,3}(?:\.\d{1,2})?)\s*kv\b", 1)
    rows = rows.withColumns({"family": T.first_of(F.col("description"), T.FAMILIES), "size": F.regexp_replace(F.lower(size), " ", ""), "kv": kv})
    km = F.col("unit") == "km"
    rows = rows.withColumn("quantity", F.when(km, F.col("quantity") * 1000).otherwise(F.col("quantity"))).withColumn("unit", F.when(km, "m").otherwise(F.col("unit")))
    key = F.when(F.col("family").isNotNull() & (F.col("size") != ""), F.concat_ws("|", "family", "size", F.nullif("kv", F.lit(""))))
    return rows.where("quantity > 0 and length(description) >= 4").select("document", "page", "family", "size", "kv", "unit", "quantity", key.alias("key"))
