"""A small sample of a package that shows every document and as many categories as it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

CATEGORIES = tuple(dict.fromkeys(c for c, _ in T.SIGNALS))

PICK = "struct<document:bigint,position:bigint,page:bigint,size:int,mask:bigint,gain:bigint>"


def category_mask(text) -> F.Column:
    """A bit for each of CATEGORIES whose pattern the text holds."""
    found = T.signals(F.coalesce(text, F.lit("")))
    return sum((F.when(F.array_contains(found, c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(CATEGORIES)), F.lit(0)).cast("long")


def names(mask) -> F.Column:
    """The categories of a mask, sorted and joined."""
    held = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(CATEGORIES)])
    return F.array_join(F.array_sort(F.array_compact(held)), ", ")


def representative_chunks(chunks: DataFrame, most: int = 10, per_document: int = 2) -> DataFrame:
    """The sample of each tender: tender, nth, document, position, page, size, categories, new_categories, reason.

    chunks: tender, document, position, page (numbers; position is a chunk's place in its tender and its own), text. First the best
    chunk of each document, by categories, then length, then page, in the documents' order; then, while there is room, the
    chunk that adds most categories, of documents with fewer than per_document in the sample. Texts that are null or blank are not
    taken. Of chunks of one document with the same categories only the first per_document can ever be taken,
    so that many go on: a tender has at most most documents in that step, each with a row or two for every set of categories.
    """
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    rows = chunks.select("tender", *[F.col(c).cast("long") for c in ("document", "position", "page")], size.cast("int").alias("size"), category_mask(F.col("text")).alias("mask"))
    order = [F.col("size").desc(), "page", "position"]
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("tender", "document").orderBy(F.bit_count("mask").desc(), *order))).where("nth = 1 and size > 0")
    begins = rows.groupBy("tender", "document").agg(F.min("position").alias("begins"))
    best = best.join(begins, ["tender", "document"]).withColumn("nth", F.row_number().over(Window.partitionBy("tender").orderBy("begins"))).where(F.col("nth") <= most)
    pick = F.struct("document", "position", "page", "size", "mask", F.lit(0).cast("long").alias("gain"))
    first = best.groupBy("tender").agg(F.array_sort(F.collect_list(F.struct("nth", pick.alias("pick")))).alias("firsts"))
    first = first.select("tender", F.transform("firsts", lambda x: x["pick"]).alias("picks"))
    rest = rows.where("size > 0").join(first.where(F.size("picks") < most).select("tender"), "tender", "left_semi")
    rest = rest.withColumn("nth", F.row_number().over(Window.partitionBy("tender", "document", "mask").orderBy(*order))).where(F.col("nth") <= per_document)
    rest = rest.join(begins, ["tender", "document"]).groupBy("tender").agg(F.collect_list(F.struct("document", "position", "page", "size", "mask", "begins")).alias("rest"))
    both = first.join(rest, "tender", "left")
    covered = lambda picks: F.aggregate(picks, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(p["mask"]))

    def add(picks, _):
        """picks with the best chunk that is left, if there is room and it adds a category."""
        had = covered(picks)
        free = F.filter("rest", lambda c: (F.size(F.filter(picks, lambda p: p["document"] == c["document"])) < per_document) & ~F.exists(picks, lambda p: p["position"] == c["position"]))
        scored = F.transform(free, lambda c: F.struct(F.bit_count(c["mask"].bitwiseAND(F.bitwise_not(had))).cast("long").alias("gain"), F.bit_count(c["mask"]).alias("n"), c["size"].alias("size"), (-c["page"]).alias("page"), (-c["begins"]).alias("begins"), (-c["position"]).alias("position"), c.alias("c")))
        top = F.array_max(scored)
        won = F.struct(*[top["c"][f].alias(f) for f in ("document", "position", "page", "size", "mask")], top["gain"].alias("gain"))
        return F.when((F.size(picks) < most) & (top["gain"] > 0), F.concat(picks, F.array(won))).otherwise(picks)

    start = F.col("picks").cast(f"array<{PICK}>")
    both = both.withColumn("picks", F.when(F.col("rest").isNull(), start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, add)))
    out = both.select("tender", F.posexplode("picks").alias("nth", "pick"), "picks")
    before = covered(F.slice("picks", F.lit(1), F.col("nth")))
    new = F.col("pick.mask").bitwiseAND(F.bitwise_not(before))
    reason = F.when(F.col("pick.gain") > 0, "category coverage").otherwise("document coverage")
    return out.select("tender", "nth", "pick.document", "pick.position", "pick.page", "pick.size", names(F.col("pick.mask")).alias("categories"), names(new).alias("new_categories"), reason.alias("reason"))
