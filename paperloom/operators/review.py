"""Checks on requirements and evidence: links, provenance, gates, coverage, pair rules and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Categories that a structured fact may stand for, and the least overlap.
SUPPRESSIBLE, LEAST_OVERLAP = ("COMMERCIAL", "SCHEDULE", "TECHNICAL", "EQUIPMENT", "FINANCIAL"), 0.6


def amendment_links(requirements: DataFrame, addenda: DataFrame) -> DataFrame:
    """tender_id, line, source, status for requirements (tender_id, line, document, text) whose text holds an addendum's.

    addenda: tender_id, source, needle, clarification. Addenda meet requirements of their own tender only, an
    equi-join. Without a link, a requirement of a document named addendum or clarification is SUPERSESSION_UNKNOWN.
    """
    rows = requirements.withColumn("form", T.normal_form(F.col("text")))
    needles = addenda.select("tender_id", "source", "clarification", T.normal_form(F.col("needle")).alias("part")).where("part <> ''")
    status = F.when(F.col("clarification"), "CLARIFICATION").otherwise("AMENDED")
    linked = rows.join(needles, "tender_id").where(F.contains("form", "part")).select("tender_id", "line", "source", status.alias("status"))
    named = rows.where(F.lower("document").rlike("addendum|clarification")).join(linked, ["tender_id", "line"], "left_anti")
    return linked.union(named.select("tender_id", "line", F.col("document").alias("source"), F.lit("SUPERSESSION_UNKNOWN")))


def lifecycle(requirements: DataFrame, links: DataFrame) -> DataFrame:
    """Status of each requirement's first link by source, ORIGINAL without one."""
    first = links.groupBy("tender_id", "line").agg(F.min_by("status", F.struct("source", "status")).alias("status"))
    return requirements.select("tender_id", "line").join(first, ["tender_id", "line"], "left").select("tender_id", "line", F.coalesce("status", F.lit("ORIGINAL")).alias("status"))


def _violations(*checks: tuple[str, str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(r).alias("reason"))) for c, r, wrong in checks]))


def provenance_violations(requirements: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """subject, check, reason for every break between requirements, evidence and the candidates they come from.

    requirements: requirement_id, candidate_id, document, page, text, summary; evidence: evidence_id, requirement_id,
    candidate_id, document, page, fact; candidates: candidate_id, document, page, text, parent. A null differs from
    any value. A row whose partner is missing gets that violation alone.
    """
    r, c, e = requirements.alias("r"), candidates.alias("c"), evidence.alias("e")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    lost, found = F.col("c.candidate_id").isNull(), F.col("c.candidate_id").isNotNull()
    of_r = _violations(
        ("R1", "unknown_candidate", lost),
        ("R1", "cross_document_drift", found & differ("r.document", "c.document")),
        ("R1", "cross_page_drift", found & differ("r.page", "c.page")),
        ("R1", "source_text_mismatch", found & differ("r.text", "c.text")),
        ("R2", "missing_parent_chunk", found & (F.coalesce("c.parent", F.lit("")) == "")),
        ("R6", "non_canonical_id", found & (~F.col("r.requirement_id").startswith("REQ-") | (F.col("r.requirement_id") == F.col("r.candidate_id")))),
    )
    first = r.join(c, F.col("r.candidate_id") == F.col("c.candidate_id"), "left").select(F.col("r.requirement_id").alias("subject"), F.inline(of_r))
    orphan, held = F.col("r.requirement_id").isNull(), F.col("r.requirement_id").isNotNull()
    of_e = _violations(
        ("R3", "orphan_evidence", orphan),
        ("R3", "candidate_mismatch", held & differ("e.candidate_id", "r.candidate_id")),
        ("R4", "cross_document_drift", held & differ("e.document", "r.document")),
        ("R4", "cross_page_drift", held & differ("e.page", "r.page")),
        ("R5", "fact_summary_mismatch", held & differ("e.fact", "r.summary")),
    )
    return first.union(e.join(r, F.col("e.requirement_id") == F.col("r.requirement_id"), "left").select(F.col("e.evidence_id"), F.inline(of_e)))


def schema_gates(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """violations of rows (id, requirement_id, category, confidence, mandatory), comma-joined; empty when all gates hold."""
    gates = (("id_pattern", ~F.coalesce(F.col("requirement_id").rlike("^REQ-"), F.lit(False))), ("category_enum", ~F.coalesce(F.col("category").isin(*categories), F.lit(False))), ("confidence_range", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))))
    return rows.select("id", F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in gates])), ",").alias("violations"))


def structured_coverage(candidates: DataFrame, facts: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Best fact of each candidate that one covers: id, fact, overlap (share of the candidate's tokens), ties to the least fact.

    candidates: id, tokens, signals (comma-joined); facts: fact, tokens; tokens are distinct. Only candidates whose signals are all
    suppressible take part. A fact that covers n tokens to this share holds one of the rarest n - ceil(least n) + 1,
    so only these are joined; tokens no fact holds count as rarest and find nothing.
    """
    signals = F.split("signals", ",")
    able = candidates.where((F.col("signals") != "") & F.forall(signals, lambda s: s.isin(*SUPPRESSIBLE)) & (F.size("tokens") > 0))
    index = facts.select("fact", F.col("tokens").alias("held"), F.explode("tokens").alias("token"))
    often = index.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    ranked = able.select("id", "tokens", F.explode("tokens").alias("token")).join(often, "token", "left")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(0)), "token"))
    n = F.size("tokens")
    probes = ranked.withColumn("nth", nth).where(F.col("nth") <= n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1).where("often is not null")
    pairs = probes.select("id", "tokens", "token").join(index, "token").dropDuplicates(["id", "fact"])
    share = F.size(F.array_intersect("tokens", "held")) / n
    rows = pairs.select("id", "fact", share.alias("share")).where(F.col("share") >= least)
    best = rows.groupBy("id").agg(F.min_by(F.struct("fact", "share"), F.struct(-F.col("share"), F.col("fact"))).alias("b"))
    return best.select("id", "b.fact", F.bround("b.share", 3).alias("overlap"))


def gap_summary(requirements: DataFrame, *keys: str) -> DataFrame:
    """Requirements, unknown mandatory flags, missing sources, unknown categories, and rows that need review, by keys."""
    unknown, unsourced, unnamed = F.col("mandatory").isNull(), F.coalesce("document", F.lit("")) == "", F.col("category") == "UNKNOWN"
    return requirements.groupBy(*keys).agg(F.count(F.lit(1)).alias("requirements"), F.count_if(unknown).alias("mandatory_unknown"), F.count_if(unsourced).alias("missing_source"), F.count_if(unnamed).alias("unknown_category"), F.count_if(unknown | unsourced | F.coalesce(unnamed, F.lit(False))).alias("to_review"))


def pair_rules(pairs: DataFrame, today: str) -> DataFrame:
    """verdict and reason of requirement-evidence pairs that rules alone decide; both null where a scorer has to.

    pairs: id, own_tender, source_tender, reusable, valid_until, entity, evidence_entity, text, fact. First that holds.
    """
    first, second = F.lower("text").rlike("first[ -]category"), F.lower("fact").rlike("second[ -]category|grade 2")
    rules = (
        ("MISSING", "wrong tender", F.col("source_tender").isNotNull() & (F.col("source_tender") != F.col("own_tender")) & ~F.coalesce("reusable", F.lit(False))),
        ("REVIEW", "expired", F.col("valid_until") < F.lit(today).cast("date")),
        ("REVIEW", "ambiguous entity", F.col("entity") == "AMBIGUOUS"),
        ("MISSING", "wrong entity", (F.col("entity") != F.col("evidence_entity")) & (F.col("entity") != "CONSORTIUM") & (F.col("evidence_entity") != "CONSORTIUM")),
        ("FAIL", "contradiction", first & second),
        ("MISSING", "no fact", F.trim(F.coalesce("fact", F.lit(""))) == ""),
    )
    pick = F.coalesce(*[F.when(test, F.struct(F.lit(v).alias("verdict"), F.lit(why).alias("reason"))) for v, why, test in rules])
    return pairs.select("*", pick.alias("__p")).select(*pairs.columns, "__p.verdict", "__p.reason")


def score_pairs(pairs: DataFrame, today: str, scorer=None) -> DataFrame:
    """verdict, reason and path of every pair: rules first, then scorer for the rest.

    scorer gives a verdict column from the pair's columns text and fact, and may be any column expression or pandas
    UDF; it sees undecided rows only. Without one, token overlap decides: below 0.15 MISSING, up to 0.5 REVIEW, else PASS.
    """
    ruled = pair_rules(pairs, today)
    a, b = T.tokens(F.col("text")), T.tokens(F.coalesce("fact", F.lit("")))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    default = F.when(overlap < 0.15, "MISSING").when(overlap <= 0.5, "REVIEW").otherwise("PASS")
    decided = ruled.where("verdict is not null").withColumn("path", F.lit("rules"))
    rest = ruled.where("verdict is null").withColumn("verdict", F.coalesce(scorer(F.col("text"), F.col("fact")) if scorer else default, F.lit("REVIEW"))).withColumn("reason", F.lit("score")).withColumn("path", F.lit("scorer"))
    return decided.unionByName(rest)


def signal_evaluation(rows: DataFrame, signals: list[str], together: list[tuple[str, str]] = ()) -> DataFrame:
    """flagged, precision, recall, FPR and FNR of boolean columns of rows (wrong, ...) as signs of wrong, and of pairs of them."""
    flags = {s: F.col(s) for s in signals} | {f"{a}_or_{b}": F.col(a) | F.col(b) for a, b in together}
    long = rows.select("wrong", F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), c.alias("flag")) for n, c in flags.items()])))
    w, f = F.col("wrong"), F.col("flag")
    n = long.groupBy("signal").agg(F.count_if(f).alias("flagged"), F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & w).alias("fn"), F.count_if(~f & ~w).alias("tn"))
    ratio = lambda x, y: F.coalesce(F.bround(F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0)), 4), F.lit(0.0))
    return n.select("signal", "flagged", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("fpr"), ratio("fn", "tp").alias("fnr"))


def attribute_accuracy(predicted: DataFrame, gold: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Rows matched on key and, of each attribute, the share of equal values (null equals null)."""
    both = predicted.alias("p").join(gold.alias("g"), key)
    same = [F.bround(F.count_if(F.col(f"p.{a}").eqNullSafe(F.col(f"g.{a}"))) / F.count(F.lit(1)), 4).alias(a) for a in attributes]
    return both.agg(F.count(F.lit(1)).alias("matched"), *same)
