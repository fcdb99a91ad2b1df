"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured once. For each language, source and length class a logarithmic quantile sketch
of each measure is kept: counts by bucket, each bucket 2 % wider than the one before, which merge by
addition. Fences lie beyond the deciles by REACH times the distance from median to decile, and replace fixed
cutoffs. A group's fences are drawn to those of its language over all sources, the more the fewer documents it
has, and are joined to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table

MIN_WORDS, MAX_REPEATS, WINDOW, SYMBOLS = 10, 20, 5, "#*$%&|<>"
#: Relative width of a sketch bucket, fences in distances from median to decile, and the documents that a language's fences weigh.
GAMMA, REACH, PRIOR = 1.02, 3.0, 100
#: Least distance of each measure that is taken from median to decile.
MEASURES = {"mean_length": 0.25, "symbol_rate": 0.04, "dup_rate": 0.12, "repeat_rate": 0.055}
SPACE = " \t\n\v\f\r"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        seen = Counter(windows)
        if len(seen) < len(windows):
            reach = 0
            for at, window in enumerate(windows):
                if seen[window] > 1:
                    repeats += at + WINDOW - max(at, reach)
                    reach = at + WINDOW
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column(3)]
        columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *names])


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: bucket b holds values over GAMMA**(b-1) and up to GAMMA**b; null is zero."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    rows = measured.select(*keys, named.alias("m")).select(*keys, "m.measure", "m.value")
    bucket = F.when(F.col("value") > 1e-9, F.ceil(F.log("value") / F.log(F.lit(GAMMA))))
    return rows.groupBy(*keys, "measure", F.coalesce(bucket, F.lit(-(10**6))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, and a low and a high fence for each measure."""
    group = Window.partitionBy(*keys, "measure")
    sofar = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumn("total", F.sum("n").over(group)).withColumn("sofar", sofar)
    value = F.when(F.col("bucket") == -(10**6), 0.0).otherwise(F.pow(F.lit(GAMMA), "bucket") * 2 / (1 + GAMMA))
    quantile = lambda q: F.min(F.when(F.col("sofar") >= F.col("total") * q, value))
    per = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), quantile(0.1).alias("q1"), quantile(0.5).alias("q5"), quantile(0.9).alias("q9"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
    per = per.withColumn("low", F.col("q1") - REACH * F.greatest(F.col("q5") - F.col("q1"), least))
    per = per.withColumn("high", F.col("q9") + REACH * F.greatest(F.col("q9") - F.col("q5"), least))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return per.groupBy(*keys).agg(F.max("docs").alias("docs"), *[pick(m, side) for m in MEASURES for side in ("low", "high")])


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    A null text has no words and fails. Null languages and sources are groups of their own. Null doc_ids and
    repeated rows are kept; no rows give no rows; other columns of docs are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = plain.mapInArrow(_measures, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*counts, "n_lines"]))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    words = F.greatest("n_words", F.lit(1))
    # length classes: 10 to 39 words, 40 to 159, and so on by fours, the last open
    size = F.least(F.floor(F.log(4.0, words / F.lit(10.0))), F.lit(3)).cast("int")
    measured = measured.withColumns({"l": key("lang"), "s": key("source"), "size": size, "mean_length": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words, "dup_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_rate": F.col("n_repeat_words") / words})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))
    measured = shared_table(measured.withColumn("base_failed", failed), "measured")
    fine = shared_table(sketches(measured.where("not base_failed"), ["l", "s", "size"]), "sketches")
    own = fences(fine, ["l", "s", "size"])
    wide = fences(merge(fine, ["l", "size"]), ["l", "size"])
    wide = wide.select("l", "size", *[F.col(c).alias(f"wide_{c}") for c in wide.columns[3:]])
    own = own.join(wide, ["l", "size"])
    sides = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    weight = F.col("docs") / (F.col("docs") + PRIOR)
    own = own.select("l", "s", "size", *[(weight * F.col(c) + (1 - weight) * F.col(f"wide_{c}")).alias(c) for c in sides])
    judged = measured.join(own, ["l", "s", "size"], "left")
    out = F.array_compact(F.array(*[F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in MEASURES]))
    judged = judged.withColumn("failed_rules", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(out))
    return judged.select("doc_id", *counts, "base_failed", (F.size("failed_rules") == 0).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op3_quality_rules": op3_quality_rules}
