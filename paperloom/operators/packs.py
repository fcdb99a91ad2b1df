"""Evidence scopes, quotation sets, specification packages, risk signals, summaries and routed judgements of tenders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.similarity import written

# Least confidence of a FAIL, least length of a quote.
LEAST_FAIL, LEAST_QUOTE = 0.8, 12
# Most requirements picked for a package, most specifications and shown pages of one.
MOST_PICKED, MOST_SPECS = 60, 40
#: So many first pages at most are broadcast; more are merged.
FEW = 100_000


def evidence_in_scope(evidence: DataFrame) -> DataFrame:
    """(tender_id, id, own) of evidence (id, tender_id, source_tender): under its requirement's tender and under its own source's.

    Both tenders of a row are exploded, so that the either-or is no join on a disjunction; one row where they are the same.
    """
    both = F.array_distinct(F.array_compact(F.array("tender_id", "source_tender")))
    return evidence.select(F.explode(both).alias("scope"), "id", "tender_id").select(F.col("scope").alias("tender_id"), "id", F.col("tender_id").eqNullSafe(F.col("scope")).alias("own"))


def quotes_of_requests(quotes: DataFrame, requests: DataFrame, tenders: DataFrame) -> DataFrame:
    """Quotations (rfq, tender_id, ...) with their request's columns (rfq, ...), for the tenders (tender_id) only."""
    return quotes.join(tenders.select("tender_id"), "tender_id", "left_semi").join(requests, "rfq")


def audit_of_decisions(audit: DataFrame, decisions: DataFrame) -> DataFrame:
    """Audit rows (decision, ...) that belong to a decision (decision, ...), with its columns."""
    return audit.join(decisions, "decision")


def foreign_results(results: DataFrame, tenders: DataFrame) -> DataFrame:
    """Results (tender_id, source, result) whose source is not their tender's owner (tender_id, owner: not null)."""
    return results.join(tenders.where("owner is not null"), "tender_id").where(~F.col("source").eqNullSafe(F.col("owner")))


def clear_foreign(results: DataFrame, tenders: DataFrame) -> DataFrame:
    """Every result, with result and source set to null where foreign_results() would name it."""
    foreign = F.col("owner").isNotNull() & ~F.col("source").eqNullSafe(F.col("owner"))
    joined = results.join(tenders.select("tender_id", "owner"), "tender_id", "left")
    return joined.select("tender_id", F.when(~foreign, F.col("source")).alias("source"), F.when(~foreign, F.col("result")).alias("result"), foreign.alias("cleared"))


def package_of_specs(quoted: DataFrame, titles: DataFrame) -> DataFrame:
    """(spec, package, votes): the package of a specification's title (spec, package), else that of most quoting pages (spec, package).

    Ties go to the package first in order. Votes are counted per (spec, package) before the best is chosen.
    """
    votes = quoted.groupBy("spec", "package").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("spec").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("package").alias("p"))).alias("b"))
    joined = best.join(titles.select("spec", F.col("package").alias("title")), "spec", "full_outer")
    return joined.select("spec", F.coalesce("title", "b.p").alias("package"), F.coalesce(-F.col("b.v"), F.lit(0)).alias("votes"))


def assembled_packages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Packages of pages (package, kind, document, page) with two pages or more: page ranges per kind and document, and specs.

    specs (package, spec) are counted, and the first 40 listed by rank, so that no long list is gathered.
    """
    once = pages.distinct()
    enough = once.groupBy("package").agg(F.count_distinct("document", "page").alias("pages")).where("pages >= 2")
    island = F.col("page") - F.row_number().over(Window.partitionBy("package", "kind", "document").orderBy("page"))
    runs = once.withColumn("g", island).groupBy("package", "kind", "document", "g").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    ranges = runs.groupBy("package", "kind", "document").agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("r"))
    ranges = ranges.select("package", "kind", "document", F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("ranges"))
    nth = F.row_number().over(Window.partitionBy("package").orderBy("spec"))
    listed = specs.distinct().withColumn("nth", nth).where(F.col("nth") <= MOST_SPECS).groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("spec")), ",").alias("specs"))
    return ranges.join(enough, "package").join(listed, "package", "left").withColumn("specs", F.coalesce("specs", F.lit("")))


def picked_requirements(requirements: DataFrame, packages: tuple[tuple[str, str], ...], most: int = MOST_PICKED) -> DataFrame:
    """(package, position, id) of requirements (id, text) that a package's pattern finds, the first 60 by id."""
    hits = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(name)) for name, p in packages]))
    rows = requirements.select("id", F.explode(hits).alias("package"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("package").orderBy("id"))).where(F.col("position") <= most)


def checked_verdict(verdict: Column, confidence: Column, quote: Column, text: Column, form: Callable[[Column], Column]) -> Column:
    """REVIEW unless the quote's normal form has 12 characters or more and stands in the text's, and a FAIL is sure to 0.8."""
    held = F.coalesce(F.contains(form(text), form(quote)) & (F.length(form(quote)) >= LEAST_QUOTE), F.lit(False))
    return F.when((verdict == "FAIL") & (F.coalesce(confidence, F.lit(0.0)) < LEAST_FAIL), "REVIEW").when(verdict.isin("PASS", "FAIL") & ~held, "REVIEW").otherwise(verdict)


def failed_reasons(checks: Column) -> Column:
    """Array of 'label: detail' for the failed of an array of (label, detail, status)."""
    return F.transform(F.filter(checks, lambda c: c["status"] == "FAIL"), lambda c: F.concat_ws(": ", c["label"], c["detail"]))


def _matches_nothing(pattern: str) -> bool:
    """Whether pattern may match an empty text; one that Python does not know may."""
    try:
        return re.search(pattern, "") is not None
    except re.error:
        return True


def first_matches(pages: DataFrame, patterns: tuple[tuple[str, str], ...], around: int = 40) -> DataFrame:
    """(document, name, page, snippet): the first page of each document that each pattern finds; nothing where none does.

    Pages are searched for the patterns alone, which is quick, and only the first of each document for what stands around them.
    """
    within = {n: F.regexp_extract("text", f"(?i)(.{{0,{around}}}(?:{p}).{{0,{around}}})", 1) for n, p in patterns}
    named = F.array_compact(F.array(*[F.when(within[n] != "" if _matches_nothing(p) else F.col("text").rlike(f"(?i)(?:{p})"), F.lit(n)) for n, p in patterns]))
    firsts = pages.select("document", "page", F.explode(named).alias("name")).groupBy("document", "name").agg(F.min(F.struct("page")).alias("first"))
    firsts = written(firsts.select(F.col("document").alias("of"), "name", F.col("first.page").alias("first")), "firsts")
    chosen = firsts.select("of", "first").distinct()
    chosen = F.broadcast(chosen) if firsts.count() <= FEW else chosen.hint("merge")
    rows = pages.join(chosen, F.col("document").eqNullSafe(F.col("of")) & F.col("page").eqNullSafe(F.col("first")), "left_semi")
    rows = rows.select("document", "page", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), within[n].alias("snippet")) for n, _ in patterns])).alias("m"))
    rows = rows.select("document", "page", "m.name", "m.snippet").where("snippet <> ''")
    return rows.groupBy("document", "name").agg(F.min(F.struct("page", "snippet")).alias("f")).select("document", "name", "f.page", "f.snippet")


def risk_signals(tenders: DataFrame, **counts: DataFrame) -> DataFrame:
    """(tender_id, kind, severity, n) of counts (tender_id, n) by kind, and 'no_bid_security' of tenders (tender_id, has_security) without one."""
    severity = {"gaps": "HIGH", "conflicts": "HIGH", "ambiguities": "MEDIUM"}
    out = tenders.where(~F.coalesce("has_security", F.lit(False))).select("tender_id", F.lit("no_bid_security").alias("kind"), F.lit("HIGH").alias("severity"), F.lit(1).cast("long").alias("n"))
    for kind, rows in counts.items():
        out = out.unionByName(rows.where("n > 0").select("tender_id", F.lit(kind).alias("kind"), F.lit(severity.get(kind, "LOW")).alias("severity"), F.col("n").cast("long").alias("n")))
    return out


def run_accuracy(rows: DataFrame, *run: str) -> DataFrame:
    """n, accuracy and mean latency of rows (correct: boolean, latency) per run."""
    return rows.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.bround(F.count_if("correct") / F.count(F.lit(1)), 4).alias("accuracy"), F.bround(F.sum("latency") / F.count("latency"), 1).alias("latency"))


def quick_summary(tenders: DataFrame, requirements: DataFrame, risks: DataFrame, today: str) -> DataFrame:
    """Per tender (tender_id, deadline): counts, days left, the six largest categories, the three gravest risks, next actions in order.

    requirements (tender_id, category, mandatory, status) and risks (tender_id, severity, title) are summed per
    tender first; lists hold at most the number of categories, and three risks kept by rank.
    """
    per = requirements.groupBy("tender_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("mandatory").alias("m"), F.count_if(F.col("status") == "MISSING_EVIDENCE").alias("missing"), F.count_if(F.col("status") == "REVIEW").alias("review"))
    largest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))), 1, 6)
    sums = per.groupBy("tender_id").agg(F.sum("n").alias("requirements"), F.sum("m").alias("mandatory"), F.sum("missing").alias("missing"), F.sum("review").alias("review"), F.array_join(F.transform(largest, lambda x: x["category"]), ",").alias("categories"))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("tender_id").orderBy("rank", "title"))
    first = risks.withColumn("rank", rank).withColumn("nth", nth).where("nth <= 3").groupBy("tender_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]), ",").alias("risks"))
    rows = tenders.join(sums, "tender_id", "left").join(first, "tender_id", "left").fillna(0, ["requirements", "mandatory", "missing", "review"]).fillna("", ["categories", "risks"])
    days = F.datediff("deadline", F.lit(today).cast("date")).cast("long")
    actions = F.array_compact(F.array(F.when(F.col("requirements") == 0, F.lit("extract")), F.when(days.between(0, 7), F.lit("close")), F.when(F.col("missing") > 0, F.lit("collect")), F.when(F.col("review") > 0, F.lit("review")), F.when(F.col("risks") != "", F.lit("clear risks"))))
    return rows.select("tender_id", "requirements", "mandatory", "missing", "review", "categories", "risks", days.alias("days_left"), F.array_join(F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("submit"))), ",").alias("actions"))


def routed(rows: DataFrame, primary: Callable[[pd.Series], pd.DataFrame], escalate: Callable[[pd.Series], pd.DataFrame], least: float) -> DataFrame:
    """(id, label, confidence, route) of rows (id, text), judged by the primary provider and, below least or on a fault, by the next.

    A provider takes a series of texts and gives label and confidence. A fault of both becomes route FAILED, never a lost
    row; rows stay where they are, in Arrow batches.
    """

    def ask(provider, texts: pd.Series) -> pd.DataFrame:
        try:
            return provider(texts).set_axis(texts.index)
        except Exception:  # a provider's fault is a status of its rows
            one = [provider_or_none(provider, t) for t in texts]
            return pd.DataFrame(one, columns=["label", "confidence"], index=texts.index)

    def provider_or_none(provider, text):
        try:
            return tuple(provider(pd.Series([text])).iloc[0])
        except Exception:
            return None, None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = ask(primary, batch["text"])[["label", "confidence"]].copy()
            out["confidence"] = out["confidence"].astype(float)
            again = out.index[out["label"].isna() | (out["confidence"] < least)]
            out["route"] = "PRIMARY"
            if len(again):
                out.loc[again, ["label", "confidence"]] = ask(escalate, batch.loc[again, "text"])[["label", "confidence"]]
                out.loc[again, "route"] = "ESCALATED"
            out.loc[out["label"].isna(), "route"] = "FAILED"
            out["label"] = out["label"].where(out["label"].notna(), None)
            yield pd.concat([batch["id"], out], axis=1)[["id", "label", "confidence", "route"]]

    return rows.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(judge, "id long, label string, confidence double, route string")


def sentence_around(text: Column, pattern: str) -> Column:
    """The sentence around the first match: from the previous . or line end to the next; empty where none."""
    return F.trim(F.regexp_extract(text, f"(?i)([^.\\n]*(?:{pattern})[^.\\n]*)", 1))


def date_of(text: Column) -> Column:
    """A date written in one of the usual ways, day first; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy")])


# Classes of documents in order, with what a file name, its end or the beginning of the first page holds.
DOCUMENT_CLASSES = (
    ("BOQ", ("price", "schedule", "boq", "bill of quantities"), (), ()),
    ("TECHNICAL", ("technical", "specification", "specs"), (), ("gis", "transformer", "voltage")),
    ("COMMERCIAL", ("commercial", "financial"), (), ()),
    ("LEGAL", ("consortium", "agreement"), (), ()),
    ("CLARIFICATION", ("clarification",), (), ()),
    ("ADDENDUM", ("addendum",), (), ()),
    ("DRAWING", ("drawing",), (".dwg", ".jpg"), ()),
    ("SCHEDULE", (), (), ("schedule", "programme")),
)
SAMPLE = 500


def document_class(name: Column, sample: Column) -> Column:
    """Class of a document by its file name and the beginning of its first page, the first that fits; OTHER if none does."""
    low, page = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.substring(F.coalesce(sample, F.lit("")), 1, SAMPLE))

    def fits(inside: tuple[str, ...], at_end: tuple[str, ...], on_page: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for held in [*[low.contains(k) for k in inside], *[low.endswith(k) for k in at_end], *[page.contains(k) for k in on_page]]:
            test = test | held
        return test

    return F.coalesce(*[F.when(fits(*held), F.lit(n)) for n, *held in DOCUMENT_CLASSES], F.lit("OTHER"))


def uncertainty(rows: DataFrame, least_chars: int = 40, slow: float = 400.0) -> DataFrame:
    """Boolean signs of a doubtful answer of rows (id, label, known, text, quote, latency), and how many there are."""
    signs = {
        "unknown": F.col("label").isNull() | (F.col("label") == "UNKNOWN"),
        "mismatch": ~F.col("label").eqNullSafe(F.col("known")),
        "short": F.length(F.coalesce("text", F.lit(""))) < least_chars,
        "not_verbatim": ~F.coalesce(F.contains("text", "quote"), F.lit(False)),
        "degenerate": F.size(F.array_distinct(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))) <= 2,
        "slow": F.coalesce(F.col("latency") > slow, F.lit(False)),
    }
    return rows.select("id", *[c.alias(n) for n, c in signs.items()], sum(c.cast("int") for c in signs.values()).alias("signs"))


def notices_of_json(lines: DataFrame) -> DataFrame:
    """id, title, country, kind of JSON lines (line, at): torn lines, empty ids and titles go, the first of an id stays.

    Contact columns of the feed are never read.
    """
    parsed = lines.select("at", F.from_json("line", "id string, title string, country string, kind string", {"mode": "PERMISSIVE"}).alias("n")).select("at", "n.*")
    rows = parsed.where("coalesce(trim(id), '') <> '' and coalesce(trim(title), '') <> ''")
    return rows.groupBy("id").agg(F.min(F.struct("at", "title", "country", "kind")).alias("f")).select("id", "f.title", "f.country", "f.kind")


def kind_of_file(name: Column, head: Column) -> Column:
    """Kind by the first bytes (binary), else by the name's extension."""
    starts = lambda h: F.hex(F.substring(head, 1, len(h) // 2)) == h
    low = F.lower(name)
    magic = (("pdf", "25504446"), ("zip", "504B0304"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("html", "3C21444F"), ("parquet", "50415231"))
    ends = (("pdf", "pdf"), ("sheet", "xlsx?|ods|csv"), ("text", "txt|log|md|docx?"), ("image", "png|jpe?g|tiff?"))
    return F.coalesce(*[F.when(starts(h), F.lit(n)) for n, h in magic], *[F.when(low.rlike(rf"\.({e})$"), F.lit(n)) for n, e in ends], F.lit("unknown"))
