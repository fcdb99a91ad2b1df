"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order, once for each pass over the source. A copy's
virtual finish time is the number of words its source has sent by then, over the source's weight. All
copies are range-sorted by it, and the mix is cut where the running total would pass the budget. A source
that has no passes left stops sending, which gives the rest to the others by weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, line_digest, lines_once, ordered_totals, running_total, shared_table, shuffled, split_join, word_count

WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source of sizes (source, size): source_size, weight, target, budget.

    Sources by code point, null last, take the weights in turn. A target is the weight times a common
    level, but at most passes times the source's size; the level is where the targets sum to the budget,
    the greatest of (budget - sizes capped so far) / (weights left) with sources in order of cap over weight.
    Where there are too many sources for one task, both orders are range sorts.
    """
    per = shared_table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = per.count()
    per = per.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    per = ordered_totals(per, ["none", "source"], {"one": "nth"}, n)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * passes).withColumn("full_at", F.col("cap") / F.col("weight"))
    per = ordered_totals(per, ["full_at", "none", "source"], {"cap": "caps", "weight": "heavier"}, n)
    words, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (words or 0) * float(share)
    left = weight - (F.col("heavier") - F.col("weight")) if weight else F.lit(1)
    level = per.agg(F.max((F.lit(budget) - (F.col("caps") - F.col("cap"))) / left)).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"), F.lit(budget).alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 1, line: F.Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, weight, target, copies, taken (copies times size), line.

    Size is the number of words, 0 for a null text. A null source is a source of its own, a null doc_id a
    document like any other. Whole documents are taken, so a source's words differ from its target by less
    than one document, or by what that leaves to the others. Repeated rows are documents of their own; rows
    that tie in all of order, doc_id, size and line are alike. No rows give no rows; other columns are not read.
    line is a column that tells rows apart further, empty if not given.
    """
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), (F.lit("") if line is None else line).alias("line"))
    sizes = sizes.withColumn("pos", shuffled(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumn("row", F.monotonically_increasing_id())
    sizes = shared_table(sizes, "sizes")
    targets = shared_table(source_targets(sizes, weights, share, passes), "targets")
    rows = sizes.count()
    keyed = sizes.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    per_queue = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("queue"), "source_size", "weight", "target", "budget")
    keyed = split_join(keyed, per_queue, "queue")
    sent = running_total(keyed, ["queue"], ["pos", "doc_id", "size", "line", "row"], "size", "sent", rows)
    copies = sent.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("weight"))
    queued = ordered_totals(copies.drop("sent", "queue"), ["finish", "pos", "doc_id", "size", "line", "row", "pass"], {"size": "running"})
    held = ["doc_id", "source", "size", "source_size", "weight", "target", "line"]
    taken = F.sum((F.col("running") <= F.col("budget")).cast("long"))
    mixed = queued.groupBy("row").agg(*[F.first(c).alias(c) for c in held], taken.alias("copies"))
    return mixed.select(*held[:-1], "copies", (F.col("copies") * F.col("size")).alias("taken"), "line")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a document as many times as it is taken; all columns.

    Rows alike in every column are one row with the sum of their copies, given out again as so many rows.
    """
    taken = mix(docs, line=line_digest(docs), **how).groupBy("line").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = lines_once(docs).join(taken.hint("merge"), "line")  # both lie by line
    thousands = F.ceil(F.col("copies") / 1000).cast("int")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), thousands)))
    each = F.when(F.col("part") < thousands, 1000).otherwise(F.col("copies") - (thousands - 1) * 1000)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), each.cast("int")))).select("held.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
e AS (SELECT *, md5(concat_ws('/', '1', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)) AS pos FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
        (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, weight, budget, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM f),
q AS (SELECT e.*, source_size, weight, budget, target, sum(size) OVER (PARTITION BY e.source ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
      FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, p, (p * source_size + sent)::DOUBLE / weight AS finish FROM q, range(2) r(p)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, pos, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS running FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN running <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id
"""
}
QUERIES = {"op1_mixing": op1_mixing}
