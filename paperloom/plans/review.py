"""Queries on notices, reminders, review checks, table changes and exports over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import changes, facts, notices, pages, review, tables
from paperloom.plans import decide, texts
from paperloom.sources.tables import AS_OF, requirements, risks, table, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CAPABILITY = {"work_types": ["substation", "cable"], "max_kv": 220, "countries": ["NATION_1", "NATION_2", "NATION_3", "NATION_5"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- notices and reminders

NOTICE = """nt AS (SELECT o_orderkey AS id, ['substation', 'cable', 'generation', NULL][(o_orderkey % 4 + 1)::INT] AS work_type, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5) * 110 END AS kv, n_name AS country, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS deadline
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""
RADAR = f"""{NOTICE}, rf AS (SELECT id, deadline - DATE '{AS_OF}' AS days, (work_type IN ('substation', 'cable'))::INT::DOUBLE AS w, (kv <= 220)::INT::DOUBLE AS v, (lower(country) IN ('nation_1', 'nation_2', 'nation_3', 'nation_5'))::INT::DOUBLE AS c FROM nt),
rd AS (SELECT *, CASE WHEN days < 0 THEN 0.0 WHEN days < 14 THEN 0.5 WHEN days >= 14 THEN 1.0 END::DOUBLE AS d FROM rf),
rn AS (SELECT *, (w IS NOT NULL)::INT + (v IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS n, coalesce(w, 0) + coalesce(v, 0) + coalesce(c, 0) + coalesce(d, 0) AS s FROM rd),
ra AS (SELECT *, CASE WHEN n > 1 OR n = 1 AND d IS NULL THEN round_even(100 * s / n, 0)::BIGINT END AS match FROM rn),
radar AS (SELECT id, match, CASE WHEN match IS NULL THEN 'INSUFFICIENT_DATA' WHEN coalesce(v = 0, false) OR coalesce(w = 0, false) OR match < 50 THEN 'WEAK' WHEN match >= 75 THEN 'STRONG' ELSE 'FAIR' END AS status, days AS days_left FROM ra)"""


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, sf, "orders").join(customer, "o_custkey", "left").join(table(spark, sf, "nation"), "n_nationkey", "left")
    kind = F.element_at(F.array(F.lit("substation"), F.lit("cable"), F.lit("generation"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kv = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5 * 110)
    return rows.select(F.col("o_orderkey").alias("id"), kind.alias("work_type"), kv.alias("kv"), F.col("n_name").alias("country"), F.when(F.col("o_orderkey") % 7 > 0, F.to_date("o_orderdate")).alias("deadline"))


@query(f"WITH {RADAR} SELECT id, match, status, days_left::DOUBLE AS days_left FROM radar")
def notice_radar(spark, sf):
    rows = notices.radar(_notices(spark, sf), CAPABILITY, AS_OF)
    return rows.withColumn("days_left", F.col("days_left").cast("double"))


@query(f"WITH {RADAR} SELECT count(*) AS total, count(*) FILTER (status = 'STRONG') AS strong, count(*) FILTER (days_left BETWEEN 0 AND 7) AS closing FROM radar")
def radar_summary(spark, sf):
    return notices.radar_summary(notice_radar(spark, sf))


@query("""SELECT p_partkey, p_name FROM part WHERE (p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') OR p_brand IS NULL) AND p_size > 5 AND (p_name ILIKE '%a%' OR p_type ILIKE '%steel%') ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 500""")
def notice_search(spark, sf):
    rows = table(spark, sf, "part").where((F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") | F.col("p_brand").isNull()) & (F.col("p_size") > 5) & (F.col("p_name").ilike("%a%") | F.col("p_type").ilike("%steel%")))
    return rows.orderBy(F.col("p_size").desc_nulls_last(), "p_partkey").limit(500).select("p_partkey", "p_name")


@query(f"""WITH t AS (SELECT o_orderkey AS tender_id, o_orderdate::DATE AS deadline FROM orders WHERE o_orderstatus <> 'F'), k AS (SELECT l_orderkey AS tender_id, l_shipdate::DATE AS due FROM lineitem WHERE l_linestatus = 'O'),
c AS (SELECT l_orderkey AS tender_id, count(*) AS todo FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), x AS (SELECT t.*, deadline - DATE '{AS_OF}' AS d, todo FROM t LEFT JOIN c USING (tender_id))
SELECT tender_id, deadline AS due, 'deadline-passed' AS kind, -d AS n, 'HIGH' AS priority FROM x WHERE d < 0
UNION ALL SELECT tender_id, deadline, 'deadline-soon', d, CASE WHEN d <= 2 THEN 'HIGH' ELSE 'MEDIUM' END FROM x WHERE d BETWEEN 0 AND 7
UNION ALL SELECT tender_id, deadline, 'checklist-open', todo, 'HIGH' FROM x WHERE d BETWEEN 0 AND 7 AND todo > 0
UNION ALL SELECT tender_id, due, CASE WHEN due < DATE '{AS_OF}' THEN 'task-overdue' ELSE 'task-due' END, abs(due - DATE '{AS_OF}'), CASE WHEN due < DATE '{AS_OF}' THEN 'HIGH' ELSE 'MEDIUM' END FROM k SEMI JOIN t USING (tender_id) WHERE due - DATE '{AS_OF}' <= 3""")
def reminders(spark, sf):
    lines = table(spark, sf, "lineitem")
    tenders = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("tender_id"), F.to_date("o_orderdate").alias("deadline"))
    tasks = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("tender_id"), F.to_date("l_shipdate").alias("due"))
    todo = lines.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("tender_id")).agg(F.count(F.lit(1)).alias("todo"))
    return notices.reminders(tenders, tasks, todo, AS_OF)


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END AS decided, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS deadline FROM orders)
SELECT id, decided IS NULL AS waiting, row_number() OVER (PARTITION BY decided IS NULL ORDER BY CASE WHEN decided IS NULL THEN deadline END NULLS LAST, decided DESC NULLS LAST, id) AS position FROM r""")
def approvals(spark, sf):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", day).alias("decided_at"), F.when(F.col("o_orderkey") % 7 > 0, day).alias("deadline"))
    return notices.approvals(rows)


@query("SELECT c_custkey AS account, 400000::BIGINT AS quota, coalesce(used, 0)::BIGINT AS used, greatest(400000 - coalesce(used, 0), 0)::BIGINT AS free FROM customer LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT) AS used FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def storage_quota(spark, sf):
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.lit(400000).cast("long").alias("quota"))
    return notices.storage(accounts, table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.floor("o_totalprice").alias("size")))


@query("SELECT tender_id, count(*) AS files, sum(coalesce(length(text), 0))::BIGINT AS chars, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS languages, sum(coalesce(length(text), 0)) < 100 * count(*) AS scanned FROM (SELECT *, doc_id % 50 AS tender_id FROM documents) GROUP BY 1")
def file_inventory(spark, sf):
    return notices.file_inventory(table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("tender_id"), "lang", "text"))


DOC_PAGES = "pg AS (SELECT doc_id // 6 AS document, doc_id AS page, text, doc_id % 4 = 0 OR doc_id % 90 < 12 AS failed FROM documents)"


@query(f"""WITH {DOC_PAGES}, p AS (SELECT document, count(*) AS pages, count(*) FILTER (failed) AS n_failed, sum(length(trim(coalesce(text, ''))))::BIGINT AS chars FROM pg GROUP BY 1),
s AS (SELECT document, string_agg(page::VARCHAR, ',' ORDER BY page) AS f FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page) AS k FROM pg WHERE failed) WHERE k <= 20 GROUP BY 1)
SELECT p.*, CASE WHEN n_failed = pages AND chars <= 50 THEN 'FAILED' WHEN n_failed > 0 OR chars <= 50 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, coalesce(f, '') AS failed_pages FROM p LEFT JOIN s USING (document)""")
def document_status(spark, sf):
    bad = F.col("doc_id") % 4 == 0
    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 6).alias("document"), F.col("doc_id").alias("page"), "text", (bad | (F.col("doc_id") % 90 < 12)).alias("failed"))
    return notices.document_status(rows)


@query(f"""WITH {texts.PAGES}, {texts.REFS}, d AS (SELECT DISTINCT reference, split_part(reference, ' ', 1) AS kind, split_part(reference, ' ', 2) AS rest FROM rf)
SELECT reference, kind, CASE WHEN regexp_matches(rest, '^\\d') THEN 0 WHEN regexp_matches(rest, '^[IVXLCDM]+$') THEN 1 ELSE 2 END AS class, CASE WHEN regexp_matches(rest, '^\\d') THEN regexp_extract(rest, '^(\\d+)', 1)::INT WHEN rest = 'C' THEN 100 ELSE 0 END AS number, rest FROM d""")
def natural_order(spark, sf):
    return notices.natural_order(facts.references(texts.page_rows(spark, sf)).select("reference").distinct())


# ---- amendments, provenance, gates

LINE = "ln AS (SELECT DISTINCT l_orderkey AS tender_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)"
AMEND = f"""{LINE}, rq AS (SELECT tender_id, line, part, supplier, CASE WHEN line = 6 THEN 'Addendum 1.pdf' ELSE 'Scope.pdf' END AS document, {texts._form_sql("concat_ws(' ', p_name, p_type)")} AS form FROM ln),
ad AS (SELECT tender_id, concat('A', part) AS source, supplier % 2 = 0 AS clar, {texts._form_sql("p_type")} AS part_ FROM ln WHERE part % 7 = 0),
lk AS (SELECT rq.tender_id, line, source, CASE WHEN clar THEN 'CLARIFICATION' ELSE 'AMENDED' END AS status FROM rq JOIN ad ON ad.tender_id = rq.tender_id AND contains(form, part_)),
li AS (SELECT * FROM lk UNION ALL SELECT tender_id, line, document, 'SUPERSESSION_UNKNOWN' FROM rq ANTI JOIN lk USING (tender_id, line) WHERE regexp_matches(lower(document), 'addendum|clarification'))"""


def _amendments(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct().join(part, "part")
    reqs = lines.select("tender_id", "line", F.when(F.col("line") == 6, "Addendum 1.pdf").otherwise("Scope.pdf").alias("document"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    addenda = lines.where("part % 7 = 0").select("tender_id", F.concat(F.lit("A"), "part").alias("source"), F.col("p_type").alias("needle"), (F.col("supplier") % 2 == 0).alias("clarification"))
    return reqs, review.amendment_links(reqs, addenda)


@query(f"WITH {AMEND} SELECT * FROM li")
def amendment_links(spark, sf):
    return _amendments(spark, sf)[1]


@query(f"WITH {AMEND}, ff AS (SELECT tender_id, line, arg_min(status, (source, status)) AS status FROM li GROUP BY 1, 2) SELECT tender_id, line, coalesce(status, 'ORIGINAL') AS status FROM (SELECT DISTINCT tender_id, line FROM rq) LEFT JOIN ff USING (tender_id, line)")
def requirement_lifecycle(spark, sf):
    reqs, links = _amendments(spark, sf)
    return review.lifecycle(reqs.select("tender_id", "line").distinct(), links)


PROVENANCE = """c AS (SELECT concat('C-', doc_id) AS candidate_id, source AS document, doc_id AS page, text, CASE WHEN doc_id % 5 > 0 THEN 'chunk' END AS parent FROM documents),
r AS (SELECT concat(CASE WHEN doc_id % 11 = 0 THEN 'C-' ELSE 'REQ-' END, doc_id) AS requirement_id, concat('C-', CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END) AS candidate_id, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE source END AS document, doc_id + (doc_id % 19 = 0)::INT AS page, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE text END AS text, lang AS summary FROM documents),
e AS (SELECT concat('E-', doc_id) AS evidence_id, concat('REQ-', doc_id) AS requirement_id, concat('C-', doc_id) AS candidate_id, source AS document, doc_id AS page, CASE WHEN doc_id % 29 = 0 THEN 'xx' ELSE lang END AS fact FROM documents)"""


def _provenance(spark, sf):
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    c = docs.select(F.concat(F.lit("C-"), i).alias("candidate_id"), F.col("source").alias("document"), i.alias("page"), "text", F.when(i % 5 > 0, "chunk").alias("parent"))
    r = docs.select(F.concat(F.when(i % 11 == 0, "C-").otherwise("REQ-"), i).alias("requirement_id"), F.concat(F.lit("C-"), F.when(i % 13 == 0, -i - 1).otherwise(i)).alias("candidate_id"), F.when(i % 17 == 0, "other").otherwise(F.col("source")).alias("document"), (i + (i % 19 == 0).cast("int")).alias("page"), F.when(i % 23 != 0, F.col("text")).alias("text"), F.col("lang").alias("summary"))
    e = docs.select(F.concat(F.lit("E-"), i).alias("evidence_id"), F.concat(F.lit("REQ-"), i).alias("requirement_id"), F.concat(F.lit("C-"), i).alias("candidate_id"), F.col("source").alias("document"), i.alias("page"), F.when(i % 29 == 0, "xx").otherwise(F.col("lang")).alias("fact"))
    return r, e, c


def _check(table_: str, subject: str, check: str, reason: str, test: str) -> str:
    return f"SELECT {subject} AS subject, '{check}' AS \"check\", '{reason}' AS reason FROM {table_} WHERE {test}"


@query(f"WITH {PROVENANCE}, rc AS (SELECT r.*, c.candidate_id AS cc, c.document AS cd, c.page AS cp, c.text AS ct, c.parent AS pa FROM r LEFT JOIN c USING (candidate_id)), er AS (SELECT e.*, r.requirement_id AS rr, r.candidate_id AS rc, r.document AS rd, r.page AS rp, r.summary AS rs FROM e LEFT JOIN r USING (requirement_id))\n" + " UNION ALL ".join([
    _check("rc", "requirement_id", "R1", "unknown_candidate", "cc IS NULL"),
    _check("rc", "requirement_id", "R1", "cross_document_drift", "cc IS NOT NULL AND document IS DISTINCT FROM cd"),
    _check("rc", "requirement_id", "R1", "cross_page_drift", "cc IS NOT NULL AND page IS DISTINCT FROM cp"),
    _check("rc", "requirement_id", "R1", "source_text_mismatch", "cc IS NOT NULL AND text IS DISTINCT FROM ct"),
    _check("rc", "requirement_id", "R2", "missing_parent_chunk", "cc IS NOT NULL AND coalesce(pa, '') = ''"),
    _check("rc", "requirement_id", "R6", "non_canonical_id", "cc IS NOT NULL AND (requirement_id NOT LIKE 'REQ-%' OR requirement_id = candidate_id)"),
    _check("er", "evidence_id", "R3", "orphan_evidence", "rr IS NULL"),
    _check("er", "evidence_id", "R3", "candidate_mismatch", "rr IS NOT NULL AND candidate_id IS DISTINCT FROM rc"),
    _check("er", "evidence_id", "R4", "cross_document_drift", "rr IS NOT NULL AND document IS DISTINCT FROM rd"),
    _check("er", "evidence_id", "R4", "cross_page_drift", "rr IS NOT NULL AND page IS DISTINCT FROM rp"),
    _check("er", "evidence_id", "R5", "fact_summary_mismatch", "rr IS NOT NULL AND fact IS DISTINCT FROM rs"),
]))
def provenance_violations(spark, sf):
    return review.provenance_violations(*_provenance(spark, sf))


@query(f"""SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'id_pattern' END, CASE WHEN coalesce(source, '') NOT IN ('src0', 'src1', 'src2') THEN 'category_enum' END, CASE WHEN NOT coalesce(n_chars / 1000 BETWEEN 0 AND 1, false) THEN 'confidence_range' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents""")
def schema_gates(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 11 == 0, "C-").otherwise("REQ-"), "doc_id").alias("requirement_id"), F.col("source").alias("category"), (F.col("n_chars") / 1000).alias("confidence"))
    return review.schema_gates(rows, ("src0", "src1", "src2"))


@query(with_sql("requirement") + "SELECT tender_id, count(*) AS requirements, count(*) FILTER (part % 5 = 0) AS mandatory_unknown, count(*) FILTER (part % 7 = 0) AS missing_source, count(*) FILTER (part % 9 = 0) AS unknown_category, count(*) FILTER (part % 5 = 0 OR part % 7 = 0 OR part % 9 = 0) AS to_review FROM requirement GROUP BY 1")
def gap_summary(spark, sf):
    rows = requirements(table(spark, sf, "lineitem"))
    marked = rows.select("tender_id", F.when(F.col("part") % 5 != 0, F.col("mandatory")).alias("mandatory"), F.when(F.col("part") % 7 != 0, "Scope.pdf").alias("document"), F.when(F.col("part") % 9 == 0, "UNKNOWN").otherwise(F.col("category")).alias("category"))
    return review.gap_summary(marked, "tender_id")


FACT_TOKENS = texts.TOK.format(texts._form_sql("sentence"))


@query(texts.ALL + f""", cd AS (SELECT id, tok, len(tok) AS n FROM (SELECT id, {FACT_TOKENS} AS tok, signals FROM acc WHERE len(list_filter(string_split(signals, ','), lambda s: NOT list_contains(['COMMERCIAL', 'SCHEDULE', 'TECHNICAL', 'EQUIPMENT', 'FINANCIAL'], s))) = 0) WHERE len(tok) > 0),
fx AS (SELECT item_id AS fact, {FACT_TOKENS} AS tok FROM (SELECT item_id, concat_ws(' ', text, ([{", ".join("'" + c + "'" for c in texts.CLAUSES)}])[(item_id % 12 + 1)::INT]) AS sentence FROM benchmark)),
pr AS (SELECT id, fact, len(list_intersect(cd.tok, fx.tok))::DOUBLE / n AS s FROM cd, fx)
SELECT id, fact, round_even(s, 3) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, fact) AS k FROM pr WHERE s >= 0.6) WHERE k = 1""")
def structured_coverage(spark, sf):
    rows = texts._accepted(spark, sf).select("id", "signals", T.tokens(F.col("sentence")).alias("tokens"))
    clause = F.element_at(F.array(*map(F.lit, texts.CLAUSES)), (F.col("item_id") % 12 + 1).cast("int"))
    known = table(spark, sf, "benchmark").select(F.col("item_id").alias("fact"), T.tokens(F.concat_ws(" ", "text", clause)).alias("tokens"))
    return review.structured_coverage(rows, known)


PAIR = f"""pa AS (SELECT l_orderkey AS id, l_linenumber AS line, l_orderkey AS own, CASE WHEN l_suppkey % 4 = 0 THEN l_orderkey + l_suppkey % 3 END AS src, l_partkey % 2 = 0 AS reusable, l_shipdate::DATE AS valid, ['CONSORTIUM', 'LEAD', 'PARTNER', 'AMBIGUOUS'][(l_partkey % 4 + 1)::INT] AS en, ['CONSORTIUM', 'LEAD', 'PARTNER'][(l_suppkey % 3 + 1)::INT] AS ee, concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' first category' ELSE '' END) AS text, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE concat(s_name, ' ', p_type, CASE WHEN l_suppkey % 5 = 0 THEN ' second category' ELSE '' END) END AS fact
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
ru AS (SELECT *, CASE WHEN src <> own AND NOT reusable THEN 'MISSING wrong tender' WHEN valid < DATE '{AS_OF}' THEN 'REVIEW expired' WHEN en = 'AMBIGUOUS' THEN 'REVIEW ambiguous entity' WHEN en <> ee AND en <> 'CONSORTIUM' AND ee <> 'CONSORTIUM' THEN 'MISSING wrong entity' WHEN regexp_matches(lower(text), 'first[ -]category') AND regexp_matches(lower(fact), 'second[ -]category|grade 2') THEN 'FAIL contradiction' WHEN trim(coalesce(fact, '')) = '' THEN 'MISSING no fact' END AS r FROM pa),
ov AS (SELECT *, len(list_intersect({texts.TOK.format(texts._form_sql("text"))}, {texts.TOK.format(texts._form_sql("coalesce(fact, '')"))}))::DOUBLE / greatest(len({texts.TOK.format(texts._form_sql("text"))}), 1) AS o FROM ru)"""


@query(f"WITH {PAIR} SELECT id, line, CASE WHEN r IS NOT NULL THEN split_part(r, ' ', 1) WHEN o < 0.15 THEN 'MISSING' WHEN o <= 0.5 THEN 'REVIEW' ELSE 'PASS' END AS verdict, CASE WHEN r IS NULL THEN 'score' ELSE substr(r, strpos(r, ' ') + 1) END AS reason, CASE WHEN r IS NULL THEN 'scorer' ELSE 'rules' END AS path FROM ov")
def pair_verdicts(spark, sf):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    rows = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    s = F.col("l_suppkey")
    pairs = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("own_tender"), F.when(s % 4 == 0, F.col("l_orderkey") + s % 3).alias("source_tender"), (F.col("l_partkey") % 2 == 0).alias("reusable"), F.to_date("l_shipdate").alias("valid_until"), pick(("CONSORTIUM", "LEAD", "PARTNER", "AMBIGUOUS"), F.col("l_partkey") % 4).alias("entity"), pick(("CONSORTIUM", "LEAD", "PARTNER"), s % 3).alias("evidence_entity"), F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " first category").otherwise("")).alias("text"), F.when(s % 10 != 0, F.concat("s_name", F.lit(" "), "p_type", F.when(s % 5 == 0, " second category").otherwise(""))).alias("fact"))
    return review.score_pairs(pairs, AS_OF).select("id", "line", "verdict", "reason", "path")


SIGNS = ["short", "tagged", "odd"]


@query("""WITH r AS (SELECT quality = 0 AS wrong, n_chars < 400 AS short, contains(text, '#') AS tagged, doc_id % 3 = 0 AS odd FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
l AS (SELECT wrong, 'short' AS signal, short AS f FROM r UNION ALL SELECT wrong, 'tagged', tagged FROM r UNION ALL SELECT wrong, 'odd', odd FROM r UNION ALL SELECT wrong, 'short_or_tagged', short OR tagged FROM r),
n AS (SELECT signal, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND wrong) AS tp, count(*) FILTER (f AND NOT wrong) AS fp, count(*) FILTER (NOT f AND wrong) AS fn, count(*) FILTER (NOT f AND NOT wrong) AS tn FROM l GROUP BY 1)
SELECT signal, flagged, coalesce(round_even(tp::DOUBLE / nullif(tp + fp, 0), 4), 0.0)::DOUBLE AS precision, coalesce(round_even(tp::DOUBLE / nullif(tp + fn, 0), 4), 0.0)::DOUBLE AS recall, coalesce(round_even(fp::DOUBLE / nullif(fp + tn, 0), 4), 0.0)::DOUBLE AS fpr, coalesce(round_even(fn::DOUBLE / nullif(fn + tp, 0), 4), 0.0)::DOUBLE AS fnr FROM n""")
def signal_evaluation(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality is not null and text is not null")
    flags = rows.select((F.col("quality") == 0).alias("wrong"), (F.col("n_chars") < 400).alias("short"), F.contains("text", F.lit("#")).alias("tagged"), (F.col("doc_id") % 3 == 0).alias("odd"))
    return review.signal_evaluation(flags, SIGNS, [("short", "tagged")])


@query("SELECT count(*) AS matched, round_even(count(*) FILTER (lang IS NOT DISTINCT FROM CASE WHEN doc_id % 6 = 0 THEN 'en' ELSE lang END)::DOUBLE / count(*), 4) AS lang, round_even(count(*) FILTER (source IS NOT DISTINCT FROM CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END)::DOUBLE / count(*), 4) AS source FROM documents WHERE doc_id % 2 = 0")
def attribute_accuracy(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    gold = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "en").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    return review.attribute_accuracy(docs, gold, "doc_id", ["lang", "source"])


# ---- changes and exports


@query("""WITH cu AS (SELECT event_id AS key, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, event_id % 5 = 0 AS answered FROM events WHERE event_id % 4 > 0), wa AS (SELECT event_id AS key, event_type AS kind FROM events WHERE event_id % 4 < 2)
SELECT * FROM cu WHERE NOT (kind IN ('error', 'view') AND status = 'OPEN' AND NOT answered AND key NOT IN (SELECT key FROM wa)) UNION ALL SELECT key, kind, 'OPEN', false FROM wa WHERE key NOT IN (SELECT key FROM cu)""")
def issue_sync(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("kind"))
    current = rows.where("key % 4 > 0").select("key", "kind", F.when(F.col("key") % 3 == 0, "CLOSED").otherwise("OPEN").alias("status"), (F.col("key") % 5 == 0).alias("answered"))
    return changes.sync_issues(current, rows.where("key % 4 < 2"), ("error", "view"))


@query("""WITH r AS (SELECT event_id AS id, user_id AS key, event_type AS document, round(event_id % 100 / 100::DOUBLE, 2) AS confidence FROM events),
w AS (SELECT *, row_number() OVER k AS nth, first_value(document) OVER k AS bd, first_value(confidence) OVER k AS bs, row_number() OVER (PARTITION BY key, document ORDER BY confidence DESC, id) AS ind FROM r WINDOW k AS (PARTITION BY key ORDER BY confidence DESC, id))
SELECT id, key, document, confidence FROM w WHERE nth = 1 OR document <> bd AND ind = 1 AND confidence > 0.7 AND bs > 0.7""")
def confident_rows(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("document"), F.round(F.col("event_id") % 100 / 100, 2).alias("confidence"))
    return changes.confident_rows(rows)


@query("SELECT o_orderkey AS tender_id, o_custkey AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0) UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0")
def replace_groups(spark, sf):
    current = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("value"))
    incoming = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("tender_id"), F.col("l_partkey").alias("value"))
    return changes.replace_groups(current, incoming, "tender_id")


@query("""SELECT tender_id, id, version FROM (SELECT user_id AS tender_id, event_id AS id, event_id % 4 AS version, event_type = 'purchase' AS ov, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND NOT ov AND version < 3""")
def stale_decisions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("tender_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 4).alias("version"), (F.col("event_type") == "purchase").alias("override"))
    return changes.stale_decisions(rows, 3)


@query(with_sql("requirement", "evidence", "status") + """, f AS (SELECT l_orderkey AS tender_id, l_linenumber AS line, concat(CASE WHEN l_suppkey % 2 = 0 THEN '=' ELSE '' END, 'supplier ', l_suppkey, ' part ', l_partkey) AS fact FROM lineitem WHERE l_partkey % 11 <> 0),
t AS (SELECT tender_id, line, string_agg(fact, '; ' ORDER BY fact) AS e FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, line ORDER BY fact) AS nth FROM f) WHERE nth <= 3 GROUP BY 1, 2)
SELECT tender_id, line, category, status, CASE WHEN regexp_matches(e, '^[=+@-]') THEN concat('''', e) ELSE coalesce(e, '') END AS evidence, CASE status WHEN 'MISSING_EVIDENCE' THEN 'No evidence' WHEN 'REVIEW' THEN 'Needs review' WHEN 'FAIL' THEN 'Contradicted' ELSE '' END AS gap FROM status LEFT JOIN t USING (tender_id, line)""")
def compliance_matrix(spark, sf):
    lines = table(spark, sf, "lineitem")
    held = lines.where("l_partkey % 11 <> 0").select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "=").otherwise(""), F.lit("supplier "), "l_suppkey", F.lit(" part "), "l_partkey").alias("fact"))
    return changes.compliance_matrix(decide.statuses(spark, sf), held)


@query(with_sql("requirement", "evidence", "status", "decision") + """, q AS (SELECT tender_id, string_agg(concat('{"line":', line, ',"category":"', category, '","status":"', status, '"}'), ',' ORDER BY line, category, status) AS q FROM status GROUP BY 1),
k AS (SELECT o_orderkey AS tender_id, CASE o_orderpriority WHEN '1-URGENT' THEN '"HIGH"' WHEN '2-HIGH' THEN '"MEDIUM"' ELSE '' END AS k FROM orders)
SELECT tender_id, concat('{"decision":"', CASE rule WHEN 'HARD_GATE_FAIL' THEN 'NO_BID' WHEN 'ALL_MANDATORY_PASS' THEN 'BID' ELSE 'REVIEW' END, '","rule":"', rule, '","requirements":[', coalesce(q, ''), '],"risks":[', k, ']}') AS body FROM ruled LEFT JOIN q USING (tender_id) JOIN k USING (tender_id)""")
def tender_export(spark, sf):
    return changes.export_tender(decide.tender_decision(spark, sf), decide.statuses(spark, sf), risks(table(spark, sf, "orders")))


@query(with_sql("requirement", "evidence", "status") + "SELECT category, count(*) AS requirements, count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (status IN ('MISSING_EVIDENCE', 'REVIEW')) AS open FROM status GROUP BY 1")
def synthesis_counts(spark, sf):
    rows = decide.statuses(spark, sf)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("requirements"), F.count_if("mandatory").alias("mandatory"), F.count_if(F.col("status").isin("MISSING_EVIDENCE", "REVIEW")).alias("open"))


# ---- tables inside text

BILLS = """bl AS (SELECT l_orderkey AS document, l_linenumber AS item, concat(p_name, ' ', p_partkey) AS description, CASE WHEN p_size % 4 = 0 THEN 'km' ELSE 'No' END AS unit, l_quantity::DECIMAL(14,2) AS quantity, (l_extendedprice)::DECIMAL(14,2) AS price FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _bills(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    rows = table(spark, sf, "lineitem").join(part, "l_partkey")
    unit = F.when(F.col("p_size") % 4 == 0, "km").otherwise("No")
    return rows.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("item"), F.concat("p_name", F.lit(" "), "l_partkey").alias("description"), unit.alias("unit"), F.col("l_quantity").cast("decimal(14,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"))


def _pages_of(rows: DataFrame, head: str, other: str, line, other_line) -> DataFrame:
    """One page of text a document: a title, a header, its rows; odd documents have their columns in another order."""
    odd = F.col("document") % 2 == 1
    body = rows.groupBy("document").agg(F.array_join(F.array_sort(F.collect_list(F.when(odd, other_line).otherwise(line))), "\n").alias("body"))
    return body.select("document", F.lit(1).alias("page"), F.concat(F.lit("Schedule of work | to be | priced\n"), F.when(odd, other).otherwise(head), F.lit("\n"), "body", F.lit("\nTotal | | ")).alias("text"))


@query(f"WITH {BILLS} SELECT document, item::VARCHAR AS item, description, CASE WHEN unit = 'km' THEN 'm' ELSE 'no' END AS unit, quantity::DOUBLE * CASE WHEN unit = 'km' THEN 1000 ELSE 1 END AS quantity FROM bl WHERE quantity > 0")
def boq_lines(spark, sf):
    line = F.concat_ws(" | ", "item", "description", "unit", "quantity")
    other = F.concat_ws(" | ", "quantity", F.lit("x"), "description", "unit", "item")
    found = tables.boq_lines(_pages_of(_bills(spark, sf), "Item | Description | Unit | Qty", "Quantity | Note | Item  description | UOM | No", line, other))
    return found.select("document", "item", "description", "unit", "quantity")


@query(f"WITH {BILLS} SELECT document, description, CASE WHEN unit = 'km' THEN 'm' ELSE 'no' END AS unit, price::DOUBLE / CASE WHEN unit = 'km' THEN 1000 ELSE 1 END AS price, CASE WHEN document % 2 = 1 THEN 'USD' ELSE 'EGP' END AS currency, CASE WHEN document % 2 = 1 THEN quantity::DOUBLE ELSE 0.0 END AS min_qty FROM bl WHERE price > 0")
def price_list_rows(spark, sf):
    line = F.concat_ws(" | ", "description", "unit", "price")
    other = F.concat_ws(" | ", "quantity", F.lit("usd dollar"), "description", "unit", "price")
    found = tables.price_rows(_pages_of(_bills(spark, sf), "Product | Unit | Rate", "Min qty | Currency | Description | UOM | Net price", line, other), "EGP")
    return found.select("document", "description", "unit", "price", "currency", "min_qty")


@query(f"WITH {BILLS}, ce AS (SELECT document, item::VARCHAR AS item, description, quantity::VARCHAR AS q FROM bl) SELECT document, 'item' AS name, item AS cell FROM ce UNION ALL SELECT document, 'description', description FROM ce UNION ALL SELECT document, 'col_3', q FROM ce")
def sheet_rows(spark, sf):
    body = _bills(spark, sf).groupBy("document").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "item", "description", "quantity"))), "\n").alias("body"))
    return tables.sheet_rows(body.select("document", F.concat(F.lit("\n,,\nitem,description,\n"), "body", F.lit("\n , ,\n")).alias("text"))).select("document", "name", "cell")


@query(texts.LINES + "SELECT document, page, lower(line) AS label, nl AS value FROM (SELECT *, lead(line) OVER k AS nl, lead(pos) OVER k AS np FROM ln WINDOW k AS (PARTITION BY document, page ORDER BY pos)) WHERE lower(line) IN ('tender document package', 'section 4 - commercial', 'part ii') AND np - pos <= 30")
def label_values(spark, sf):
    return tables.label_values(pages.lines(texts.page_rows(spark, sf)), ("TENDER DOCUMENT PACKAGE", "Section 4 - Commercial", "PART II"))


@query("SELECT doc_id AS document, sha1(text) AS digest, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 4 = 0 AND (doc_id % 3 = 0 OR doc_id % 6 < 3) THEN 'READ' ELSE 'REUSE' END AS action FROM documents WHERE text IS NOT NULL")
def read_plan(spark, sf):
    docs, i = table(spark, sf, "documents").where("text is not null"), F.col("doc_id")
    files = docs.select(i.alias("document"), F.col("text").alias("content"))
    known = docs.where("doc_id % 5 <> 0").select(i.alias("document"), F.sha1(F.when(i % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("digest"), F.when(i % 3 == 0, "v1").otherwise("v2").alias("tools"), (i % 4 == 0).alias("failed"), F.when(i % 6 < 3, 1).otherwise(2).alias("failed_reads"))
    return tables.read_plan(files, known, "v2")


@query(rf"""WITH {texts.PAGES}, s AS (SELECT document, page, 'currency' AS slot, regexp_extract(text, '\b(SAR|USD|EGP|AED|EUR)\b', 1) AS value FROM pages_ UNION ALL SELECT document, page, 'validity', regexp_extract(text, '(?i)(valid[^.\n]{{0,60}}?\d+\s+days?)', 1) FROM pages_)
SELECT document, slot, arg_min(value, page) AS value, min(page) AS page FROM s WHERE value <> '' GROUP BY 1, 2""")
def commercial_slots(spark, sf):
    return tables.commercial_slots(texts.page_rows(spark, sf))


ELIGIBLE = f"""{NOTICE}, el AS (SELECT id AS tender_id, 'work_type' AS "check", CASE WHEN work_type IS NULL THEN 'UNCLEAR' WHEN work_type IN ('substation', 'cable') THEN 'PASS' ELSE 'FAIL' END AS result FROM nt
UNION ALL SELECT id, 'voltage', CASE WHEN kv IS NULL THEN 'UNCLEAR' WHEN kv <= 220 THEN 'PASS' ELSE 'FAIL' END FROM nt
UNION ALL SELECT id, 'country', CASE WHEN country IS NULL THEN 'UNCLEAR' WHEN country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5') THEN 'PASS' ELSE 'FAIL' END FROM nt
UNION ALL SELECT id, 'certifications', CASE WHEN id % 2 = 0 THEN 'FAIL' ELSE 'PASS' END FROM nt WHERE id % 3 > 0)"""


@query(f"WITH {ELIGIBLE} SELECT * FROM el")
def eligibility_checks(spark, sf):
    demanded = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 2 == 0, F.array(F.lit("ISO 9001"), F.lit("ISO 27001"))).otherwise(F.array(F.lit("ISO 9001")))
    rows = _notices(spark, sf).select(F.col("id").alias("tender_id"), "work_type", "kv", "country", demanded.alias("demanded"))
    return tables.eligibility(rows, CAPABILITY | {"certifications": ["ISO 9001", "ISO 14001"]})


@query(f"WITH {ELIGIBLE} SELECT tender_id, count(*) FILTER (result = 'PASS') AS met, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'UNCLEAR') AS unclear, count(*) AS total, round_even(100.0::DOUBLE * count(*) FILTER (result = 'PASS') / count(*), 0)::BIGINT AS percent FROM el GROUP BY 1")
def eligibility_score(spark, sf):
    return tables.eligibility_score(eligibility_checks(spark, sf))


@query(texts.ALL + f"""SELECT name, who, count(*) AS demands, bool_and(opt) AS optional, min(page) AS first_page, CASE WHEN who = 'partner' THEN 'PARTNER_NEEDED' WHEN name = '9001' THEN 'HELD' ELSE 'MISSING' END AS status
FROM (SELECT page, unnest(list_distinct(regexp_extract_all(sentence, '{T.ISO}', 1))) AS name, CASE WHEN regexp_matches(sentence, '(?i)manufacturer|subcontractor|supplier') THEN 'partner' ELSE 'company' END AS who, regexp_matches(sentence, '(?i)preferabl|optional|desirable') AS opt FROM sent) GROUP BY 1, 2""")
def certificate_demands(spark, sf):
    rows = texts.page_rows(spark, sf).select("document", "page", F.inline(T.sentences(F.col("text"))))
    return tables.certificate_demands(rows, T.ISO, ("9001",))
