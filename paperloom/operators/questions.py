"""Sentences of pages that answer questions, for many questions at once, in English and Arabic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R

# What a word, a phrase and a digit count, the least score, and the lengths of a sentence, its opening and a quote.
WORD, PHRASE, DIGIT, LEAST = 1.0, 2.5, 0.5, 2.0
SHORTEST, LONGEST, OPENING, QUOTE = 25, 600, 80, 300


def terms(questions: DataFrame) -> DataFrame:
    """id, term, weight: the words and phrases that questions (id, question) look for.

    Words are runs of three or more letters or digits that are no question words, phrases two of them in a row. A clause that a question
    names brings in the words and phrases of its other wordings, an Arabic one those of English packages.
    """
    low = F.lower(F.coalesce("question", F.lit("")))
    own = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}|[ء-ي]{3,}"), 0), lambda w: ~w.isin(*R.QUESTION_WORDS))
    clauses = F.flatten(F.array_compact(F.array(*[F.when(low.rlike(p), F.array(*map(F.lit, held))) for p, held in (*R.ARABIC_TERMS, *R.SYNONYMS)])))
    rows = questions.select("id", own.alias("own"), clauses.alias("more"))
    pairs = F.transform(F.arrays_zip(F.slice("own", 1, F.greatest(F.size("own") - 1, F.lit(0))).alias("a"), F.slice("own", 2, F.size("own")).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    words = F.array_union("own", F.flatten(F.transform("more", lambda t: F.split(t, " "))))
    phrases = F.array_union(pairs, F.filter("more", lambda t: t.contains(" ")))
    weighed = lambda found, weight: F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))
    return rows.select("id", F.explode(F.concat(weighed(words, WORD), weighed(phrases, PHRASE))).alias("t")).select("id", "t.*")


def sentences_of(text: Column) -> Column:
    """Parts behind . or ; and blank lines, white space collapsed, of a length that can be quoted."""
    parts = F.split(F.regexp_replace(text, r"([.;])\s+|\n{2,}", "$1\u0001"), "\u0001")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(clean, lambda s: F.length(s).between(SHORTEST, LONGEST))


def search(pages: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """id, nth, document, page, quote, score: the limit best sentences of pages (document, page, text) for each of questions (id, question).

    Of sentences with one opening the best counts, of equal ones the last by text, document and page. The questions' terms go to every
    task as one array, so questions are a list that was put, not a table that grows; a page is read once for all of them. A null text or question has no hits.
    """
    asked = terms(questions).agg(F.collect_list(F.struct("id", "term", "weight")).alias("asked")).withColumn("all", F.lit(1))
    rows = pages.select("document", "page", F.explode(sentences_of(F.col("text"))).alias("s")).withColumn("all", F.lit(1)).join(F.broadcast(asked), "all")
    low = F.lower("s")
    hits = F.filter("asked", lambda t: F.contains(low, t["term"]))
    rows = rows.select("document", "page", "s", hits.alias("hits")).where(F.size("hits") > 0)
    ids = F.array_distinct(F.transform("hits", lambda t: t["id"]))
    score = lambda i: F.aggregate(F.filter("hits", lambda t: t["id"] == i), F.lit(0.0), lambda n, t: n + t["weight"])
    rows = rows.select("document", "page", "s", F.explode(F.transform(ids, lambda i: F.struct(i.alias("id"), score(i).alias("score")))).alias("x"))
    rows = rows.select("x.id", "document", "page", "s", (F.col("x.score") + F.when(F.col("s").rlike(r"\d"), DIGIT).otherwise(0.0)).alias("score")).where(F.col("score") >= LEAST)
    best = rows.groupBy("id", F.substring("s", 1, OPENING).alias("opening")).agg(F.max(F.struct("score", "s", "document", "page")).alias("b"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.col("b.score").desc(), "b.s"))
    return best.withColumn("nth", nth).where(F.col("nth") <= limit).select("id", "nth", "b.document", "b.page", F.substring("b.s", 1, QUOTE).alias("quote"), "b.score")
