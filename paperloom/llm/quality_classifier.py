"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 low quality, 1 passable but toxic, 2 good. P(grade <= k) is the logistic of
threshold k minus one shared score, the sum of the hashed-text weights of a document's distinct features.
The fit follows the regularised leader with an L1 penalty, on a bounded sample of rated documents; every
document is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, first_of_each, shared_table

#: The fit takes at most so many rated documents of each grade, the first by MD5 of doc_id.
TRAIN_DOCS, BITS, GRADES = 4000, 18, 3
#: The L1 penalty and the documents that a feature needs, as shares of the rated documents.
PASSES, BATCH, RATE, L1, LEAST, L2 = 25, 128, 1.0, 0.01, 0.003, 0.1
#: Lengths of the beginnings of longer words that are features; languages that join words tell more by them.
STEMS = (4, 5, 6)
#: Least probability of the top grade for selection.
TAIL = 0.5


def features(text: str | None, memo: dict[bytes, int]) -> list[int]:
    """Hashed distinct features of a whole text: words in lower case without edge punctuation, their first four to six letters, what punctuation ends them, capitals."""
    mask = (1 << BITS) - 1
    found: set[int] = set()
    for word in set((text or "").encode().split()):
        at = memo.get(word)
        if at is None:
            bare = word.strip(b".,;:!?()[]{}\"'#*$%&|<>-_=+@/\\")
            tail = word[len(word.rstrip(b".,;:!?()[]{}\"'#*$%&|<>-_=+@/\\")) :]
            low = bare.decode().lower()
            names = ["w" + low, f"c{bare.isupper() and len(bare) > 1:d}", *[f"p{low[:n]}" for n in STEMS if len(low) > n]]
            at = (crc32(b"t" + tail) & mask, *[crc32(n.encode()) & mask for n in names])
            if len(memo) < 1_000_000:
                memo[word] = at
        found.update(at)
    return list(found)


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - scores[:, None])))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def fit(rows: list[list[int]], grades: np.ndarray, seed: int = 1) -> CumulativeLink:
    """Fit on feature lists and grades 0 to GRADES - 1."""
    l1, least = L1 * len(rows), max(2, LEAST * len(rows))
    held = np.bincount(np.concatenate([np.array(r, np.int64) for r in rows]), minlength=1 << BITS)
    rows = [[x for x in r if held[x] >= least] for r in rows]
    rarity = (np.log(len(rows) / np.maximum(held, 1)) / np.log(1 / LEAST)) ** 2  # what most texts have says little
    size, random = 1 << BITS, np.random.default_rng(seed)
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / len(grades), 0.02, 0.98)
    theta = np.log(share / (1 - share))
    steps = np.full(GRADES - 1, 1e-8)
    lengths = np.array([len(r) for r in rows])
    flat, ends = np.concatenate([np.array(r, np.int64) for r in rows]), np.cumsum(lengths)
    for _ in range(PASSES):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = order[at : at + BATCH]
            index = np.concatenate([flat[ends[i] - lengths[i] : ends[i]] for i in part])
            owner = np.repeat(np.arange(len(part)), lengths[part])
            used = np.unique(index)
            w[used] = np.where(np.abs(z[used]) <= l1, 0, -(z[used] - np.sign(z[used]) * l1) / ((1 + np.sqrt(n[used])) / RATE + L2))
            score = np.bincount(owner, (w * rarity)[index], len(part))
            y = grades[part]
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                upper, lower = (1 / (1 + np.exp(-(edges[y + k] - score))) for k in (1, 0))
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
            by_score = up - low  # of the loss -log p
            g = (np.bincount(index, by_score[owner], size) * rarity)[used]
            z[used] += g - (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / RATE * w[used]
            n[used] += g * g
            for k in range(GRADES - 1):
                slope = (low[y == k + 1].sum() - up[y == k].sum()) / len(part)
                steps[k] += slope * slope
                theta[k] -= 0.1 * slope / np.sqrt(steps[k])
            theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-6)
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / RATE + L2))
    return CumulativeLink((w * rarity).astype(np.float32), theta)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        lists = [features(t.as_py(), memo) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["grade", "features"])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m, memo = model.value, {}
    for batch in batches:
        scores = np.array([m.weights[features(t.as_py(), memo)].sum() for t in batch.column(1)], float)
        p = m.probabilities(scores)
        expected = p @ np.arange(GRADES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(p[:, -1]), pa.array(p[:, -1] >= TAIL)], ["doc_id", "expected_grade", "tail_probability", "selected"])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic); one of a document's labels, the lowest."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.where("doc_id is not null").select("doc_id", grade.alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, rated: DataFrame, limit: int = TRAIN_DOCS):
    """A broadcast CumulativeLink of at most limit documents of each grade; None without any. rated: doc_id, grade."""
    spark = docs.sparkSession
    chosen = first_of_each(rated, "grade", limit).select("doc_id", F.col("grade").cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    rows = shared_table(sample.mapInArrow(_features, "grade int, features array<int>"), "rated").toPandas()
    if rows.empty:
        return None
    rows = rows.assign(features=[sorted(x) for x in rows["features"]])
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["grade"][i], rows["features"][i]))]
    return spark.sparkContext.broadcast(fit(list(rows["features"]), rows["grade"].to_numpy()))


def classify(docs: DataFrame, rated: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade (0 to 2), tail_probability (of grade 2), selected (TAIL or more).

    A null text counts as empty. Null doc_ids and repeated rows are scored like any other. Without rated
    documents the figures are null and nothing is selected. Only doc_id and text of docs are read.
    """
    model = train(docs, rated, limit)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        nothing = F.lit(None).cast("double")
        return plain.select("doc_id", nothing.alias("expected_grade"), nothing.alias("tail_probability"), F.lit(False).alias("selected"))
    return plain.mapInArrow(partial(_score, model=model), "doc_id long, expected_grade double, tail_probability double, selected boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL: dict[str, str] = {}
QUERIES = {"op4_quality_classifier": op4_quality_classifier}
