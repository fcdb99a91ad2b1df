"""Queries on evidence scopes, packages, risk signals, summaries and routed judgements, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import packs as P
from paperloom.operators.decisions import requirement_status
from paperloom.plans.texts import ALL, PAGES, _accepted, _form_sql, page_rows
from paperloom.sources import tables
from paperloom.sources.tables import table, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Names and patterns of the packages and of the demands that the queries look for; all match lower-case text.
PACKAGES = (("cables", "cable|wire"), ("switchgear", "gis|breaker|switchgear"), ("transformers", "transformer|mva"), ("commercial", "bond|payment|turnover"))
DEMANDS = (("validity", "remain valid"), ("security", "bid bond|bid security"), ("certificate", "iso 9001"), ("damages", "liquidated damages"))
TODAY = "1995-06-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS tender_id, CASE WHEN l_partkey % 7 = 0 THEN l_suppkey WHEN l_partkey % 7 = 1 THEN l_orderkey END AS source_tender FROM lineitem),
s AS (SELECT tender_id, id, true AS own FROM e UNION ALL SELECT source_tender, id, false FROM e WHERE source_tender <> tender_id)
SELECT tender_id, count(*) AS evidence, count(*) FILTER (NOT own) AS from_others FROM s GROUP BY 1""")
def evidence_scope(spark, sf):
    part = F.col("l_partkey") % 7
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("tender_id"), F.when(part == 0, F.col("l_suppkey")).when(part == 1, F.col("l_orderkey")).alias("source_tender"))
    return P.evidence_in_scope(rows).groupBy("tender_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(~F.col("own")).alias("from_others"))


@query("SELECT l_partkey AS rfq, l_orderkey AS tender_id, l_suppkey AS contractor, p_brand AS discipline FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def rfq_quotes(spark, sf):
    quotes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rfq"), F.col("l_orderkey").alias("tender_id"), F.col("l_suppkey").alias("contractor"))
    requests = table(spark, sf, "part").select(F.col("p_partkey").alias("rfq"), F.col("p_brand").alias("discipline"))
    tenders = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("tender_id"))
    return P.quotes_of_requests(quotes, requests, tenders).select("rfq", "tender_id", "contractor", "discipline")


@query("SELECT o_orderkey AS decision, event_id AS audit, user_id AS actor, event_type AS action, o_orderstatus AS status FROM events JOIN orders ON o_orderkey = event_id % 2000")
def decision_audit(spark, sf):
    audit = table(spark, sf, "events").select((F.col("event_id") % 2000).alias("decision"), F.col("event_id").alias("audit"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    return P.audit_of_decisions(audit, table(spark, sf, "orders").select(F.col("o_orderkey").alias("decision"), F.col("o_orderstatus").alias("status")))


RESULTS = "r AS (SELECT o_orderkey AS tender_id, (CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 1 END)::VARCHAR AS source, o_orderpriority AS result FROM orders), w AS (SELECT o_orderkey AS tender_id, (CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END)::VARCHAR AS owner FROM orders)"


def _results(spark, sf):
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    source = F.when(key % 3 == 0, F.col("o_custkey")).when(key % 3 == 1, F.col("o_custkey") + 1)
    return orders.select(key.alias("tender_id"), source.cast("string").alias("source"), F.col("o_orderpriority").alias("result")), orders.select(key.alias("tender_id"), F.when(key % 5 > 0, F.col("o_custkey").cast("string")).alias("owner"))


@query(f"WITH {RESULTS} SELECT tender_id, source, owner, result FROM r JOIN w USING (tender_id) WHERE owner IS NOT NULL AND source IS DISTINCT FROM owner")
def foreign_results(spark, sf):
    return P.foreign_results(*_results(spark, sf)).select("tender_id", "source", "owner", "result")


@query(f"WITH {RESULTS}, j AS (SELECT r.*, owner IS NOT NULL AND source IS DISTINCT FROM owner AS cleared FROM r LEFT JOIN w USING (tender_id)) SELECT tender_id, CASE WHEN NOT cleared THEN source END AS source, CASE WHEN NOT cleared THEN result END AS result, cleared FROM j")
def foreign_cleared(spark, sf):
    return P.clear_foreign(*_results(spark, sf))


@query("""WITH v AS (SELECT l_partkey AS spec, l_suppkey % 4 AS package, count(*) AS votes FROM lineitem GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY votes DESC, package) AS k FROM v) WHERE k = 1), t AS (SELECT p_partkey AS spec, (p_size % 4)::BIGINT AS title FROM part WHERE p_size % 3 = 0)
SELECT spec, coalesce(title, package) AS package, coalesce(votes, 0) AS votes FROM b FULL JOIN t USING (spec)""")
def spec_packages(spark, sf):
    quoted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("spec"), (F.col("l_suppkey") % 4).alias("package"))
    titles = table(spark, sf, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("spec"), (F.col("p_size") % 4).cast("long").alias("package"))
    return P.package_of_specs(quoted, titles)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS package, l_returnflag AS kind, l_orderkey // 8 AS document, l_orderkey % 8 AS page FROM lineitem WHERE l_partkey % 3 = 0),
e AS (SELECT package, count(DISTINCT (document, page)) AS pages FROM p GROUP BY 1 HAVING count(DISTINCT (document, page)) >= 2),
g AS (SELECT *, page - row_number() OVER (PARTITION BY package, kind, document ORDER BY page) AS g FROM p), u AS (SELECT package, kind, document, min(page) AS lo, max(page) AS hi FROM g GROUP BY package, kind, document, g),
r AS (SELECT package, kind, document, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo::VARCHAR || '-' || hi::VARCHAR END, ',' ORDER BY lo) AS ranges FROM u GROUP BY 1, 2, 3),
s AS (SELECT package, string_agg(spec::VARCHAR, ',' ORDER BY spec) AS specs FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY spec) AS k FROM (SELECT DISTINCT l_suppkey AS package, l_partkey AS spec FROM lineitem)) WHERE k <= 40 GROUP BY 1)
SELECT package, kind, document, ranges, pages, coalesce(specs, '') AS specs FROM r JOIN e USING (package) LEFT JOIN s USING (package)""")
def rfq_packages(spark, sf):
    rows = table(spark, sf, "lineitem")
    pages = rows.where("l_partkey % 3 = 0").select(F.col("l_suppkey").alias("package"), F.col("l_returnflag").alias("kind"), F.floor(F.col("l_orderkey") / 8).alias("document"), (F.col("l_orderkey") % 8).alias("page"))
    return P.assembled_packages(pages, rows.select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("spec")))


@query(ALL + ", x AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS package FROM acc WHERE regexp_matches(lower(sentence), '{p}')" for n, p in PACKAGES) + ") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY id) AS position FROM x) WHERE position <= 60")
def package_requirements(spark, sf):
    return P.picked_requirements(_accepted(spark, sf).select("id", F.col("sentence").alias("text")), PACKAGES)


VERDICTS = "v AS (SELECT doc_id AS id, ['PASS', 'FAIL', 'REVIEW'][(doc_id % 3 + 1)::INT] AS verdict, (doc_id % 11) / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'no such words in here' WHEN doc_id % 4 = 1 THEN upper(substr(text, 1, 30)) WHEN doc_id % 4 = 2 THEN substr(text, 1, 8) END AS quote, text FROM documents)"


def _verdicts(spark, sf):
    doc = F.col("doc_id")
    verdict = F.element_at(F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("REVIEW")), (doc % 3 + 1).cast("int"))
    quote = F.when(doc % 4 == 0, "no such words in here").when(doc % 4 == 1, T.upper(F.substring("text", 1, 30))).when(doc % 4 == 2, F.substring("text", 1, 8))
    return table(spark, sf, "documents").select(doc.alias("id"), verdict.alias("verdict"), ((doc % 11) / F.lit(10.0)).alias("confidence"), quote.alias("quote"), "text")


@query(f"""WITH {VERDICTS}, h AS (SELECT id, verdict, confidence, coalesce(contains({_form_sql('text')}, {_form_sql('quote')}) AND length({_form_sql('quote')}) >= 12, false) AS held FROM v)
SELECT id, CASE WHEN verdict = 'FAIL' AND confidence < 0.8 THEN 'REVIEW' WHEN verdict IN ('PASS', 'FAIL') AND NOT held THEN 'REVIEW' ELSE verdict END AS verdict FROM h""")
def quote_checked(spark, sf):
    c = F.col
    return _verdicts(spark, sf).select("id", P.checked_verdict(c("verdict"), c("confidence"), c("quote"), c("text"), T.normal_form).alias("verdict"))


@query("SELECT o_orderkey AS tender_id, concat_ws('; ', CASE WHEN o_totalprice < 50000 THEN 'turnover: too small' END, CASE WHEN o_custkey % 3 = 0 THEN 'country: ' || o_orderpriority END, CASE WHEN o_orderstatus = 'F' THEN 'deadline: over' END) AS reasons FROM orders")
def failed_check_reasons(spark, sf):
    check = lambda label, detail, failed: F.struct(F.lit(label).alias("label"), detail.alias("detail"), F.when(failed, "FAIL").otherwise("PASS").alias("status"))
    checks = F.array(check("turnover", F.lit("too small"), F.col("o_totalprice") < 50000), check("country", F.col("o_orderpriority"), F.col("o_custkey") % 3 == 0), check("deadline", F.lit("over"), F.col("o_orderstatus") == "F"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.array_join(P.failed_reasons(checks), "; ").alias("reasons"))


@query(f"WITH {PAGES}, m AS (" + " UNION ALL ".join(f"SELECT document, page, '{n}' AS name, regexp_extract(text, '(?i)(.{{0,40}}(?:{p}).{{0,40}})', 1) AS snippet FROM pages_" for n, p in DEMANDS) + ") SELECT document, name, page, snippet FROM (SELECT *, row_number() OVER (PARTITION BY document, name ORDER BY page) AS k FROM m WHERE snippet <> '') WHERE k = 1")
def first_matches(spark, sf):
    return P.first_matches(page_rows(spark, sf), DEMANDS)


TENDER_PAGES = f"{PAGES}, tp AS (SELECT page % 50 AS tender_id, text FROM pages_)"


@query(f"""WITH {TENDER_PAGES}, t AS (SELECT tender_id, bool_or(regexp_matches(lower(text), 'bid bond')) AS s, sum(len(regexp_extract_all(text, '(?i)to be confirmed'))) AS a, count(*) FILTER (length(text) < 400) AS g, count(*) FILTER (regexp_matches(text, '\\(13%\\)')) AS c FROM tp GROUP BY 1)
SELECT tender_id, 'no_bid_security' AS kind, 'HIGH' AS severity, 1::BIGINT AS n FROM t WHERE NOT coalesce(s, false) UNION ALL SELECT tender_id, 'gaps', 'HIGH', g FROM t WHERE g > 0 UNION ALL SELECT tender_id, 'conflicts', 'HIGH', c FROM t WHERE c > 0 UNION ALL SELECT tender_id, 'ambiguities', 'MEDIUM', a::BIGINT FROM t WHERE a > 0""")
def risk_signals(spark, sf):
    pages = page_rows(spark, sf).select((F.col("page") % 50).alias("tender_id"), "text")
    per = pages.groupBy("tender_id").agg(F.max(F.lower("text").rlike("bid bond")).alias("has_security"), F.sum(F.regexp_count("text", F.lit("(?i)to be confirmed"))).alias("a"), F.count_if(F.length("text") < 400).alias("g"), F.count_if(F.col("text").rlike(r"\(13%\)")).alias("c"))
    n = lambda name: per.select("tender_id", F.col(name).alias("n"))
    return P.risk_signals(per, gaps=n("g"), conflicts=n("c"), ambiguities=n("a"))


@query("SELECT source, lang, count(*) AS n, round_even(count(*) FILTER ((n_chars > 400) = (quality = 1))::DOUBLE / count(*), 4) AS accuracy, round_even(sum(n_chars)::DOUBLE / count(n_chars), 1) AS latency FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def run_accuracy(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return P.run_accuracy(rows.select("source", "lang", ((F.col("n_chars") > 400) == (F.col("quality") == 1)).alias("correct"), F.col("n_chars").alias("latency")), "source", "lang")


@query(with_sql("requirement", "evidence", "status").rstrip() + f""", c AS (SELECT tender_id, category, count(*) AS n, count(*) FILTER (mandatory) AS m, count(*) FILTER (status = 'MISSING_EVIDENCE') AS missing, count(*) FILTER (status = 'REVIEW') AS review FROM status GROUP BY 1, 2),
s AS (SELECT tender_id, sum(n)::BIGINT AS requirements, sum(m)::BIGINT AS mandatory, sum(missing)::BIGINT AS missing, sum(review)::BIGINT AS review FROM c GROUP BY 1),
k AS (SELECT tender_id, string_agg(category, ',' ORDER BY i) AS categories FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY n DESC, category) AS i FROM c) WHERE i <= 6 GROUP BY 1),
q AS (SELECT o_orderkey AS tender_id, o_orderdate::DATE AS deadline, coalesce(requirements, 0) AS requirements, coalesce(mandatory, 0) AS mandatory, coalesce(missing, 0) AS missing, coalesce(review, 0) AS review, coalesce(categories, '') AS categories, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '' END AS risks, date_diff('day', DATE '{TODAY}', o_orderdate::DATE) AS days_left
FROM orders LEFT JOIN s ON s.tender_id = o_orderkey LEFT JOIN k ON k.tender_id = o_orderkey)
SELECT tender_id, requirements, mandatory, missing, review, categories, risks, days_left, coalesce(nullif(concat_ws(',', CASE WHEN requirements = 0 THEN 'extract' END, CASE WHEN days_left BETWEEN 0 AND 7 THEN 'close' END, CASE WHEN missing > 0 THEN 'collect' END, CASE WHEN review > 0 THEN 'review' END, CASE WHEN risks <> '' THEN 'clear risks' END), ''), 'submit') AS actions FROM q""")
def quick_summary(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    status = requirement_status(tables.requirements(lines), tables.evidence(lines))
    risks = tables.risks(orders.withColumn("title", F.col("o_orderpriority"))).join(orders.select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderpriority").alias("title")), "tender_id")
    return P.quick_summary(orders.select(F.col("o_orderkey").alias("tender_id"), F.to_date("o_orderdate").alias("deadline")), status, risks, TODAY)


def _by_length(texts: pd.Series) -> pd.DataFrame:
    n = texts.str.len()
    return pd.DataFrame({"label": (n > 1000).map({True: "LONG", False: "SHORT"}), "confidence": (n % 10) / 10})


def _by_words(texts: pd.Series) -> pd.DataFrame:
    if (texts == "").any():
        raise ValueError("nothing to judge")
    return pd.DataFrame({"label": texts.str.contains("shall", regex=False).map({True: "DEMAND", False: "PROSE"}), "confidence": 0.9})


#: Task -> provider: plain functions from texts to label and confidence.
PROVIDERS = {"length": _by_length, "words": _by_words}


@query("""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 20 = 7 THEN '' ELSE coalesce(text, '') END AS text FROM documents), p AS (SELECT *, length(text) % 10 < 5 AS again FROM t)
SELECT id, CASE WHEN NOT again THEN CASE WHEN length(text) > 1000 THEN 'LONG' ELSE 'SHORT' END WHEN text = '' THEN NULL WHEN contains(text, 'shall') THEN 'DEMAND' ELSE 'PROSE' END AS label, CASE WHEN NOT again THEN (length(text) % 10)::DOUBLE / 10 WHEN text = '' THEN NULL ELSE 0.9::DOUBLE END AS confidence, CASE WHEN NOT again THEN 'PRIMARY' WHEN text = '' THEN 'FAILED' ELSE 'ESCALATED' END AS route FROM p""")
def routed_judgements(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 20 == 7, "").otherwise(F.col("text")).alias("text"))
    return P.routed(rows, PROVIDERS["length"], PROVIDERS["words"], 0.5)


@query(f"WITH {PAGES} SELECT page, trim(regexp_extract(text, '(?i)([^.\\n]*(?:liquidated damages|bid bond)[^.\\n]*)', 1)) AS sentence FROM pages_ WHERE regexp_matches(text, '(?i)(liquidated damages|bid bond)')")
def match_sentences(spark, sf):
    what = "liquidated damages|bid bond"
    return page_rows(spark, sf).where(F.col("text").rlike(f"(?i)({what})")).select("page", P.sentence_around(F.col("text"), what).alias("sentence"))


@query("""WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d %B %Y') WHEN 3 THEN '32/01/2024' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS written, o_orderdate::DATE AS day FROM orders)
SELECT id, written, CASE WHEN id % 5 <> 3 THEN day END AS day FROM d""")
def written_dates(spark, sf):
    key, at = F.col("o_orderkey") % 5, "o_orderdate"
    form = lambda f: F.date_format(at, f)
    written = F.when(key == 0, form("dd/MM/yyyy")).when(key == 1, form("yyyy-MM-dd")).when(key == 2, form("dd MMMM yyyy")).when(key == 3, "32/01/2024").otherwise(form("dd.MM.yyyy"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), written.alias("written")).withColumn("day", P.date_of(F.col("written")))


NAMES = ("Vol 2 BOQ.xlsx", "Price list.pdf", "Technical Data.pdf", "Site plan.DWG", "Consortium draft.docx", "Commercial offer.pdf", "Clarification 3.pdf", "Addendum 1.zip", "Volume 4.pdf", "drawing list.pdf", "Photos.rar")
_class_rules = " ".join("WHEN " + " OR ".join([*[f"contains(n, '{k}')" for k in inside], *[f"ends_with(n, '{k}')" for k in at_end], *[f"contains(t, '{k}')" for k in on_page]]) + f" THEN '{c}'" for c, inside, at_end, on_page in P.DOCUMENT_CLASSES)


@query(f"WITH {PAGES} SELECT page, CASE {_class_rules} ELSE 'OTHER' END AS class FROM (SELECT page, lower(coalesce(left(text, 500), '')) AS t, lower((['" + "', '".join(NAMES) + "'])[(page % 11 + 1)::INT]) AS n FROM pages_)")
def document_classes(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("page") % 11 + 1).cast("int"))
    return page_rows(spark, sf).select("page", P.document_class(name, F.col("text")).alias("class"))


@query(f"""WITH {VERDICTS}, u AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE verdict END AS label, verdict AS known, coalesce(text, '') AS text, text AS raw, quote, length(text) AS latency FROM v),
s AS (SELECT id, label IS NULL AS unknown, label IS DISTINCT FROM known AS mismatch, length(text) < 40 AS short, NOT coalesce(contains(raw, quote), false) AS not_verbatim, len(list_distinct(regexp_split_to_array(trim(text), '\\s+'))) <= 2 AS degenerate, coalesce(latency > 400, false) AS slow FROM u)
SELECT *, unknown::INT + mismatch::INT + short::INT + not_verbatim::INT + degenerate::INT + slow::INT AS signs FROM s""")
def uncertainty_signs(spark, sf):
    rows = _verdicts(spark, sf).withColumns({"label": F.when(F.col("id") % 13 != 0, F.col("verdict")), "known": F.col("verdict"), "latency": F.length("text")})
    return P.uncertainty(rows)


@query("""WITH f AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey // 2)::VARCHAR ELSE '' END AS id, o_orderpriority AS title, o_orderstatus AS kind FROM orders WHERE o_orderkey % 10 <> 3)
SELECT id, title, 'SA' AS country, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM f WHERE id <> '') WHERE k = 1""")
def json_notices(spark, sf):
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").withColumn("id", F.when(key % 6 > 0, F.floor(key / 2).cast("string")).otherwise(""))
    line = F.to_json(F.struct("id", F.col("o_orderpriority").alias("title"), F.lit("SA").alias("country"), F.col("o_orderstatus").alias("kind"), F.lit("someone").alias("contact")))
    torn = F.substring(line, 1, 20)
    return P.notices_of_json(orders.select(key.alias("at"), F.when(key % 10 == 3, torn).otherwise(line).alias("line")))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 AND starts_with(html, '<!DO') THEN 'html' WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'sheet' ELSE 'unknown' END AS kind FROM pages")
def file_kinds(spark, sf):
    head = F.when(F.col("page_id") % 3 > 0, F.encode("html", "UTF-8")).otherwise(F.encode(F.lit("a,b"), "UTF-8"))
    name = F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 2 == 0), "List.XLSX").otherwise(F.lit("page"))
    return table(spark, sf, "pages").select("page_id", P.kind_of_file(name, head).alias("kind"))
