"""Language identification with interpolated Kneser-Ney character language models.

Each language has a character trigram model with absolute discounting and lower orders on continuation
counts. The models share sorted arrays of n-gram hashes (code points folded to small ids, packed into one
integer) with a column of log probabilities per language, and are searched by bisection for whole batches
of text at once. A document gets the language with the lowest cross-entropy per character. How far that
may lie above the usual for a text of its length is calibrated on labelled documents that a second model was
not fitted on; beyond, the document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, first_of_each, shared_table

#: The models are fitted on at most so many labelled documents of each language, the first by MD5 of doc_id.
TRAIN_DOCS = 2000
ORDER, UNKNOWN = 3, "und"
#: Rejection lies at this quantile of the excess of held-out documents, by length class: under 64 characters, 256, and so on by fours.
QUANTILE, CLASSES = 0.999, 6
#: Characters scored at a time.
PART = 200_000


@cache
def folding() -> np.ndarray:
    """For every code point: itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int32)


def letters(text: str | None) -> np.ndarray:
    """The text in lower case as code points, each run of other characters made one space, with spaces around; empty if it has no letter."""
    points = folding()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[32], points, [32]]).astype(np.int64)
    points = points[(points != 32) | np.concatenate([[True], points[:-1] != 32])]
    return points if len(points) > 1 else points[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, one row per distinct trigram of a batch; three code points of 21 bits make the key."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            p = letters(text.as_py())
            if len(p):
                p = np.concatenate([[32], p])
                by.setdefault(lang, []).append(p[:-2] << 42 | p[1:-1] << 21 | p[2:])
        for lang, keys in by.items():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n)], ["lang", "gram", "n"])


def length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log(np.maximum(n, 1) / 16) / np.log(4)), 0, CLASSES - 1).astype(int)


class Model:
    """Log probabilities of all languages over shared sorted n-gram hashes."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        grams = np.unique(np.concatenate([k for k, _ in counts.values()]))
        mask = (1 << 21) - 1
        self.alphabet = np.unique(np.concatenate([grams >> 42, grams >> 21 & mask, grams & mask]))
        self.size = len(self.alphabet) + 1  # 0 is any other letter
        code = lambda points: np.searchsorted(self.alphabet, points) + 1
        a, b, c = code(grams >> 42), code(grams >> 21 & mask), code(grams & mask)
        v, n_lang = self.size, len(langs)
        self.tri = (a * v + b) * v + c
        self.bi = np.unique(b * v + c)
        pair = np.searchsorted(self.bi, b * v + c)
        contexts = np.unique(a * v + b)
        at = np.searchsorted(contexts, a * v + b)
        self.contexts = contexts
        self.p1, self.p2, self.p3 = np.zeros((v, n_lang), np.float32), np.zeros((len(self.bi), n_lang), np.float32), np.zeros((len(grams), n_lang), np.float32)
        self.back2, self.back3 = np.zeros((v, n_lang), np.float32), np.zeros((len(contexts), n_lang), np.float32)
        bi_first, bi_last = self.bi // v, self.bi % v
        for j, lang in enumerate(langs):
            n = np.zeros(len(grams))
            key, count = counts[lang]
            n[np.searchsorted(grams, key)] = count
            n2 = np.bincount(pair, n > 0, len(self.bi))  # distinct characters before the pair
            n1 = np.bincount(bi_last, n2 > 0, v)
            d1, d2, d3 = (self._discount(x) for x in (n1, n2, n))
            uni = np.maximum(n1 - d1, 0) / n1.sum() + d1 * (n1 > 0).sum() / n1.sum() / v
            of = np.bincount(bi_first, n2, v)
            types = np.bincount(bi_first, n2 > 0, v)
            weight2 = np.where(of > 0, d2 * types / np.maximum(of, 1), 1)
            two = np.maximum(n2 - d2, 0) / np.maximum(of, 1)[bi_first] + weight2[bi_first] * uni[bi_last]
            of = np.bincount(at, n, len(contexts))
            types = np.bincount(at, n > 0, len(contexts))
            weight3 = np.where(of > 0, d3 * types / np.maximum(of, 1), 1)
            three = np.maximum(n - d3, 0) / np.maximum(of, 1)[at] + weight3[at] * two[pair]
            for table, values in ((self.p1, uni), (self.p2, two), (self.p3, three), (self.back2, weight2), (self.back3, weight3)):
                table[:, j] = np.log(values)
        self.norm = np.zeros(n_lang), np.full(CLASSES, np.inf), 0.0

    def accepts(self, best: np.ndarray, nats: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether texts of n characters in the languages numbered best are as likely as texts of these languages are."""
        mean, limit, spread = self.norm
        return (n > 0) & (nats - mean[best] <= np.maximum(limit[length_class(n)], spread / np.sqrt(np.maximum(n, 1))))

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        once, twice = (n == 1).sum(), (n == 2).sum()
        return min(0.9, max(0.1, once / max(once + 2 * twice, 1)))

    def surprisal(self, points: np.ndarray) -> np.ndarray:
        """-log p of each character after the first, by language; points start with two spaces for each text."""
        v = self.size
        i = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(i, v - 2)] == points
        code = np.where(known, i + 1, 0)
        tri = (code[:-2] * v + code[1:-1]) * v + code[2:]
        at = np.minimum(np.searchsorted(self.tri, tri), len(self.tri) - 1)
        out = self.p3[at]
        lost = np.flatnonzero(self.tri[at] != tri)
        if len(lost):
            b, c, context = code[lost + 1], code[lost + 2], code[lost] * v + code[lost + 1]
            at = np.minimum(np.searchsorted(self.bi, b * v + c), len(self.bi) - 1)
            low = np.where((self.bi[at] == b * v + c)[:, None], self.p2[at], self.back2[b] + self.p1[c])
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            out[lost] = low + np.where((self.contexts[at] == context)[:, None], self.back3[at], 0)
        return -out

    def entropies(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored in each text, and nats a character by language; 0 characters: no letter.

        Texts are scored PART characters at a time, long ones in overlapping parts, so that memory stays bounded.
        """
        n: list[int] = []
        sums: list[np.ndarray] = []
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            found = self.surprisal(np.concatenate(held))
            begins = np.cumsum([0, *map(len, held)][:-1])
            keep = np.ones(len(found), bool)
            keep[np.concatenate([begins[1:] - 1, begins[1:] - 2])] = False
            sizes = [len(h) - 2 for h in held]
            for owner, total in zip(owners, np.add.reduceat(found[keep].astype(float), np.cumsum([0, *sizes[:-1]]), axis=0)):
                sums[owner] += total
            held.clear()
            owners.clear()

        waiting = 0
        for text in texts:
            points = letters(text)
            n.append(max(len(points) - 1, 0))
            sums.append(np.zeros(len(self.langs)))
            if len(points):
                points = np.concatenate([[32], points])
            for at in range(0, len(points) - 2, PART):
                held.append(points[at : at + PART + 2])
                owners.append(len(n) - 1)
                waiting += len(held[-1])
                if waiting >= PART:
                    flush()
                    waiting = 0
        if held:
            flush()
        count = np.array(n, np.int64)
        return count, np.array(sums).reshape(len(n), len(self.langs)) / np.maximum(count, 1)[:, None]


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        n, nats = m.entropies(t.as_py() for t in batch.column(1))
        best = nats.argmin(axis=1)
        least = nats.min(axis=1)
        gap = (nats - least[:, None]) * n[:, None]
        score = np.where(n > 0, 1 / np.exp(-gap).sum(axis=1), 0.0)
        pred = [m.langs[b] if k else UNKNOWN for b, k in zip(best, n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(n, pa.int64()), pa.array(least), pa.array(m.accepts(best, least, n))], ["doc_id", "lang_pred", "score", "n_scored", "nats", "accepted"])


def _accepted(batches: Iterator[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
        yield batch.filter(next(_score(iter([plain]), model)).column(5))
        pa.default_memory_pool().release_unused()


SCORED = "doc_id long, lang_pred string, score double, n_scored long, nats double, accepted boolean"


def predict(docs: DataFrame, model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the language's probability among those learned), n_scored, nats (cross-entropy a character), accepted.

    A text that is null or has no letter gets und, score 0 and is not accepted. Texts are read whole; null
    doc_ids and repeated rows are kept. No rows give no rows; only doc_id and text are read.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(partial(_score, model=model), SCORED)


def train(docs: DataFrame, limit: int = TRAIN_DOCS):
    """A broadcast Model of docs with non-null lang, fitted and calibrated on at most limit documents of each language.

    The bound on documents bounds the model: it has fewer n-grams than those documents have characters.
    None if no labelled document has a letter.
    """
    spark = docs.sparkSession
    chosen = first_of_each(docs.where("lang is not null and text is not null"), "lang", limit).select("doc_id").distinct()
    sample = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    # a fourth is held out of a second model, which only calibrates
    fold = F.when(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0, "1").otherwise("0")
    sample = shared_table(sample.withColumn("fold", fold), "labelled")
    grams = sample.select(F.concat("fold", "lang").alias("lang"), "text").mapInArrow(_count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    grams["fold"], grams["lang"] = grams["lang"].str[0], grams["lang"].str[1:]
    fitted, part = _fitted(grams), _fitted(grams[grams["fold"] == "0"])
    if part is not None:
        scored = predict(sample.where("fold = '1'"), spark.sparkContext.broadcast(part))
        fitted.norm = calibration(scored, fitted.langs)
    return spark.sparkContext.broadcast(fitted)


def _fitted(grams) -> Model | None:
    """A Model of counts by lang and gram, which may have several rows."""
    sums = grams.groupby(["lang", "gram"], as_index=False)["n"].sum()
    counts = {lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in sums.sort_values("gram").groupby("lang")}
    return Model(sorted(counts), counts) if counts else None


def calibration(scored: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Median nats a character by language, limit of the excess over it by length class, and QUANTILE of its noise at one character.

    A quantile needs 1 / (1 - QUANTILE) documents; a class with fewer is merged with its neighbours. The noise falls with
    the root of the length; its spread is robust, from the median deviation. scored has at most TRAIN_DOCS rows of a language.
    """
    rows = scored.where("n_scored > 0").select("lang_pred", "n_scored", "nats").toPandas()
    if rows.empty:
        return np.zeros(len(langs)), np.full(CLASSES, np.inf), 0.0
    found = rows.groupby("lang_pred")["nats"].median()
    mean = np.array([found.get(x, found.mean()) for x in langs])
    n = rows["n_scored"].to_numpy()
    excess = rows["nats"].to_numpy() - mean[[langs.index(x) for x in rows["lang_pred"]]]
    of, limit = length_class(n), np.zeros(CLASSES)
    for c in range(CLASSES):
        width = next(w for w in range(CLASSES) if (abs(of - c) <= w).sum() * (1 - QUANTILE) >= 1 or w == CLASSES - 1)
        limit[c] = np.quantile(excess[abs(of - c) <= width], QUANTILE)
    sd = 1.4826 * np.median(abs(excess) * np.sqrt(n))
    return mean, limit, float(sd * NormalDist().inv_cdf(QUANTILE))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """predict() with a model of the documents that are not held out.

    Without any labelled document among those nothing can be judged: all is und with score 0, and what has a letter is accepted.
    """
    model = train(docs.where(F.coalesce(~held_out(), F.lit(True))))
    if model is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "n_scored": F.lit(0).cast("long"), "nats": F.lit(0.0), "accepted": has_letter()}
        return docs.select(F.col("doc_id").cast("long"), *[c.alias(n) for n, c in none.items()])
    return predict(docs, model)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """docs without those that the models reject; all columns, the text scored where it lies.

    Rows are tested as they pass, so nothing is joined or shuffled. Without any labelled document to learn from
    nothing can be judged, and all documents with a letter go on. Columns may have any names.
    """
    model = train(docs.where(F.coalesce(~held_out(), F.lit(True))))
    if model is None:
        return docs.where(has_letter())

    # Spark would take a dot in a name for a field
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(partial(_accepted, at=docs.columns.index("text"), model=model), plain.schema).toDF(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


SQL: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
