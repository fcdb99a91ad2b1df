"""From sentences to requirements: categories, gates, keys, provenance, packing, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R


def bridged(rows: DataFrame) -> DataFrame:
    """Requirements (id, document, category, text, stated) as decision rows: mandatory, requirement_type.

    Rows without category or text go, and all but the first of a document alike in category and text. Qualifying
    categories are mandatory unless stated is false, as what is not said needs evidence.
    """
    rows = rows.where("category is not null and category <> 'UNKNOWN' and trim(text) <> ''")
    nth = F.row_number().over(Window.partitionBy("document", "category", F.lower(F.trim("text"))).orderBy("id"))
    rows = rows.withColumn("nth", nth).where("nth = 1").drop("nth")
    mandatory = F.col("category").isin(*R.QUALIFYING) & F.coalesce(F.col("stated"), F.lit(True))
    kind = F.when(mandatory & F.col("category").isin(*R.HARD_GATES), "HARD_GATE").when(mandatory, "QUALIFICATION").otherwise("INFORMATIONAL")
    return rows.withColumn("mandatory", mandatory).withColumn("requirement_type", kind)


def final_dedup(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row by id of those alike in keys, nulls alike."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("nth = 1").drop("nth")


def gated(results: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Model results (id, category, summary, confidence) with why they are refused; no other column goes on."""
    why = F.when(F.col("category").isNull() & F.col("summary").isNull(), "NO_RESULT").when(F.trim(F.coalesce("summary", F.lit(""))) == "", "EMPTY_SUMMARY").when(~F.coalesce(F.col("category").isin(*allowed), F.lit(False)), "BAD_CATEGORY")
    return results.select("id", "category", "summary", "confidence", why.alias("refused"))


def with_provenance(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results with document, page and quote of their candidate, never their own; those of no candidate go."""
    source = candidates.select("id", "document", "page", F.substring("sentence", 1, 200).alias("quote"))
    return results.select("id", "category", "summary").join(source, "id")


def second_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second result (id, category) where it is valid, else the first."""
    rows = first.join(second.select("id", F.col("category").alias("again")), "id", "left")
    better = F.col("again").isNotNull() & (F.col("again") != "UNKNOWN")
    return rows.select("id", F.when(better, F.col("again")).otherwise(F.col("category")).alias("category"), F.coalesce(better, F.lit(False)).alias("replaced"))


def cache_split(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates with the cached result of their text's SHA-1, and whether there was one."""
    rows = candidates.withColumn("key", F.sha1("sentence")).join(cache, "key", "left")
    return rows.withColumn("hit", F.col("result").isNotNull())


def packed(pages: DataFrame, most: int = 3000) -> DataFrame:
    """document, page, part, text: the lines of each page in order, as many to a part as fit in most characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def put(acc: Column, line: Column) -> Column:
        full = F.length(acc["held"]) + 1 + F.length(line) + 1 > most
        done = F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        held = F.when(acc["held"].isNull() | full, line).otherwise(F.concat(acc["held"], F.lit("\n"), line))
        return F.struct(F.coalesce(done, acc["done"]).alias("done"), held.alias("held"))

    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    parts = F.aggregate(lines, start, put, lambda acc: F.array_compact(F.concat(acc["done"], F.array(acc["held"]))))
    return pages.select("document", "page", F.posexplode(parts).alias("part", "text"))


def grounded(replies: DataFrame) -> DataFrame:
    """Replies (id, reply, sources) with verdict: refused for links or foreign citations, empty without any, else shown; at most 900 characters."""
    cited = F.transform(F.regexp_extract_all("reply", F.lit(r"\[(\d{1,2})\]"), 1), lambda n: n.cast("int"))
    link = F.col("reply").rlike(r"(?i)https?://\S+|www\.\S+|\]\([^)]*\)|<[^>]+>")
    verdict = F.when(F.coalesce("reply", F.lit("")) == "", "none").when(link | F.exists(cited, lambda n: (n < 1) | (n > F.col("sources"))), "refused").when(F.size(cited) == 0, "empty").otherwise("shown")
    return replies.select("id", verdict.alias("verdict"), F.when(verdict == "shown", F.substring("reply", 1, 900)).alias("shown"))
