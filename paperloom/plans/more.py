"""Queries on sections, requirement rules, search and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions import text as T
from paperloom.operators import questions as A
from paperloom.operators import requirements as Q
from paperloom.operators import rollups as U
from paperloom.operators import sections as S
from paperloom.plans.texts import ALL, PAGES, SENTENCES, _accepted, page_rows
from paperloom.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _case(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_quoted(p)}) THEN '{n}'" for n, p in rules) + " END"


def _best(text: str, rules, title: str = "''", weight: int = 1) -> str:
    """List of [score, -place] structs as SQL; the greatest is the best."""
    return "list_max([" + ", ".join(f"{{'s': len(regexp_extract_all({text}, {_quoted(p)})) + {weight} * len(regexp_extract_all({title}, {_quoted(p)})), 'p': {-i}}}" for i, (_, p) in enumerate(rules)) + "])"


def _names(rules) -> str:
    return "[" + ", ".join(f"'{n}'" for n, _ in rules) + "]"


def _requirements(spark, sf) -> DataFrame:
    rows = _accepted(spark, sf)
    return rows.select("id", "document", R.category(F.col("sentence")).alias("category"), F.col("sentence").alias("text"), F.when(F.col("id") % 5 == 0, False).when(F.col("id") % 5 < 3, True).alias("stated"))


REQ = ALL + f", rq AS (SELECT id, document, {_case('sentence', R.CATEGORY_RULES)} AS category, sentence AS text, CASE WHEN id % 5 = 0 THEN false WHEN id % 5 < 3 THEN true END AS stated FROM acc)\n"


@query(REQ + "SELECT id, document, category FROM rq")
def rule_categories(spark, sf):
    return _requirements(spark, sf).select("id", "document", "category")


@query(REQ + f""", b AS (SELECT *, row_number() OVER (PARTITION BY document, category, lower(trim(text)) ORDER BY id) AS nth, category IN {R.QUALIFYING} AND coalesce(stated, true) AS mandatory FROM rq WHERE category IS NOT NULL)
SELECT id, category, mandatory, CASE WHEN mandatory AND category IN {R.HARD_GATES} THEN 'HARD_GATE' WHEN mandatory THEN 'QUALIFICATION' ELSE 'INFORMATIONAL' END AS requirement_type FROM b WHERE nth = 1""")
def bridged_requirements(spark, sf):
    return Q.bridged(_requirements(spark, sf)).select("id", "category", "mandatory", "requirement_type")


@query(REQ + "SELECT min(id) AS id, text, category, stated FROM rq GROUP BY text, category, stated")
def final_dedup(spark, sf):
    return Q.final_dedup(_requirements(spark, sf), "text", "category", "stated").select("id", "text", "category", "stated")


@query(f"WITH {PAGES}, {SENTENCES} SELECT page, line, n, left(sha1(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(sentence), '([a-z0-9]+)', 1), lambda w: length(w) > 2))), ' ')), 16) AS key FROM sent WHERE regexp_matches(sentence, {_quoted(R.ASK)}) AND NOT regexp_matches(sentence, {_quoted(R.NOT_ITEM)}) AND NOT regexp_matches(sentence, {_quoted(R.EXECUTION)})")
def bid_items(spark, sf):
    rows = page_rows(spark, sf).select("document", "page", F.inline(T.sentences(F.col("text"))))
    return rows.where(R.is_bid_item(F.col("sentence"))).select("page", "line", "n", R.item_key(F.col("sentence")).alias("key"))


@query(f"WITH {PAGES} SELECT page, regexp_matches(text, {_quoted(R.RELEVANT)}) AS relevant FROM pages_")
def relevance(spark, sf):
    return page_rows(spark, sf).select("page", F.col("text").rlike(R.RELEVANT).alias("relevant"))


@query(f"WITH {PAGES}, b AS (SELECT page, {_best('left(text, 6000)', R.DISCIPLINES)} AS b FROM pages_) SELECT page, CASE WHEN b.s > 0 THEN {_names(R.DISCIPLINES)}[1 - b.p] ELSE 'General' END AS discipline FROM b")
def page_disciplines(spark, sf):
    return page_rows(spark, sf).select("page", R.discipline(F.lit(None).cast("string"), F.col("text")).alias("discipline"))


@query(f"WITH {PAGES}, b AS (SELECT page, {_best('left(text, 8000)', R.PACKAGES, 'document', 4)} AS b FROM pages_) SELECT page, CASE WHEN b.s >= 3 THEN {_names(R.PACKAGES)}[1 - b.p] END AS package FROM b")
def page_packages(spark, sf):
    return page_rows(spark, sf).select("page", R.package(F.col("text"), F.col("document")).alias("package"))


@query(rf"WITH {PAGES}, h AS (SELECT document, page, unnest(string_split(text, chr(10))[1:80]) AS body FROM pages_) SELECT page, trim(regexp_replace(regexp_extract(body, {_quoted(R.PART_HEAD)}, 1), '\s+', ' ', 'g')) AS title FROM h WHERE length(body) <= 120 AND NOT regexp_matches(body, {_quoted(R.CONTENTS)}) AND NOT regexp_matches(body, {_quoted(R.PART_CODE)}) AND regexp_extract(body, {_quoted(R.PART_HEAD)}, 1) <> ''")
def part_headings(spark, sf):
    return S.headings(page_rows(spark, sf)).where("not numbered").select("page", "title")


@query()
def sections(spark, sf):
    return S.split_sections(page_rows(spark, sf))


@query()
def work_packages(spark, sf):
    return S.work_packages(S.split_sections(page_rows(spark, sf)))


@query(f"WITH {PAGES} SELECT page, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_quoted(R.SPEC)}), lambda m: upper(regexp_replace(m, '\\s', '', 'g'))))), ',') AS specs FROM pages_")
def spec_ids(spark, sf):
    return page_rows(spark, sf).select("page", F.array_join(R.spec_ids(F.col("text")), ",").alias("specs"))


@query(f"WITH {PAGES} SELECT page, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_quoted(R.VOLTAGE)}), lambda m: replace(m, ' ', '')))), ',') AS voltages, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_quoted(R.RATING)}), lambda m: replace(m, ' ', '')))), ',') AS ratings FROM pages_")
def voltage_levels(spark, sf):
    return page_rows(spark, sf).select("page", F.array_join(R.levels(F.col("text"), R.VOLTAGE), ",").alias("voltages"), F.array_join(R.levels(F.col("text"), R.RATING), ",").alias("ratings"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS date FROM orders")
def parsed_dates(spark, sf):
    d = F.to_date("o_orderdate")
    forms = [F.date_format(d, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "d MMMM yyyy")]
    text = F.when(F.col("o_orderkey") % 5 == 4, "some day in June").otherwise(F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", R.date_of(text).alias("date"))


@query()
def packed_paragraphs(spark, sf):
    rows = Q.packed(page_rows(spark, sf))
    return rows.select("page", "part", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"))


QUESTION = "When does the performance bond of the contract price expire?"
QUESTIONS = (QUESTION, "What is the liquidated damages clause?", "ما هي غرامة تأخير العقد؟", "Does the tender ask for an ISO certificate?", "هل يوجد محول؟", "and what?", "")
ASKED = "qs AS (SELECT unnest(range(len(q))) AS id, unnest(q) AS question FROM (SELECT [" + ", ".join(map(_quoted, QUESTIONS)) + "] AS q))"
CLAUSE_TERMS = " UNION ALL ".join(f"SELECT {_quoted(p)} AS pattern, [{', '.join(map(_quoted, held))}] AS held" for p, held in (*R.ARABIC_TERMS, *R.SYNONYMS))
FOUND = rf"""ct AS ({CLAUSE_TERMS}), ow AS (SELECT id, lower(question) AS low, list_filter(regexp_extract_all(lower(question), '[a-z0-9]{{3,}}|[ء-ي]{{3,}}'), lambda w: w NOT IN ({', '.join(map(_quoted, R.QUESTION_WORDS))})) AS own FROM qs),
mo AS (SELECT id, unnest(held) AS t FROM ow JOIN ct ON regexp_matches(low, pattern)),
tm AS (SELECT id, unnest(own) AS term, 1.0::DOUBLE AS weight FROM ow UNION SELECT id, unnest(string_split(t, ' ')), 1.0 FROM mo UNION SELECT id, unnest(list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1])), 2.5 FROM ow UNION SELECT id, t, 2.5 FROM mo WHERE contains(t, ' ')),
p AS (SELECT document, page, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.;])\s+|\n{{2,}}', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g')) AS s FROM pages_),
pn AS (SELECT *, row_number() OVER () AS r FROM p WHERE length(s) BETWEEN 25 AND 600),
d AS (SELECT id, r, any_value(document) AS document, any_value(page) AS page, any_value(s) AS s, sum(weight) + CASE WHEN regexp_matches(any_value(s), '\d') THEN 0.5 ELSE 0 END AS score FROM pn JOIN tm ON contains(lower(s), term) GROUP BY 1, 2),
bs AS (SELECT *, row_number() OVER (PARTITION BY id, left(s, 80) ORDER BY score DESC, s DESC, document DESC, page DESC) AS k FROM d WHERE score >= 2),
rk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, s) AS nth, document, page, left(s, 300) AS quote, score FROM bs WHERE k = 1)"""


@query(f"WITH {PAGES}, {ASKED}, {FOUND} SELECT document, page, quote, score FROM rk WHERE nth <= 5 AND id = 0")
def sentence_search(spark, sf):
    asked = spark.createDataFrame([(0, QUESTION)], "id long, question string")
    return A.search(page_rows(spark, sf), asked).select("document", "page", "quote", "score")


@query(f"WITH {PAGES}, {ASKED}, {FOUND} SELECT * FROM rk WHERE nth <= 5")
def question_search(spark, sf):
    return A.search(page_rows(spark, sf), spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, question string"))


@query("SELECT turn + conv_id * 1000 AS id, CASE WHEN coalesce(text, '') = '' THEN 'none' WHEN turn % 4 = 1 THEN 'refused' WHEN turn % 4 = 2 THEN 'refused' WHEN turn % 4 = 3 THEN 'empty' ELSE 'shown' END AS verdict FROM conversations")
def grounded_replies(spark, sf):
    bare = F.regexp_replace("text", r"(?i)https?://\S+|www\.\S+|[\[\]<>()]", " ")
    tail = F.element_at(F.array(F.lit(" [1][2]"), F.lit(" see www.example.com [1]"), F.lit(" [7]"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, sf, "conversations").select((F.col("turn") + F.col("conv_id") * 1000).alias("id"), F.when(F.col("text") != "", F.concat(bare, tail)).alias("reply"), F.lit(3).alias("sources"))
    return Q.grounded(rows).select("id", "verdict")


CACHE = "SELECT sha1(sentence) AS key, max(id) AS result FROM acc WHERE id % 3 = 0 GROUP BY 1"


@query(ALL + f"SELECT id, coalesce(c.result, 0) AS result, c.result IS NOT NULL AS hit FROM acc LEFT JOIN ({CACHE}) c ON c.key = sha1(sentence)")
def cache_hits(spark, sf):
    rows = _accepted(spark, sf)
    cache = rows.where("id % 3 = 0").groupBy(F.sha1("sentence").alias("key")).agg(F.max("id").alias("result"))
    return Q.cache_split(rows, cache).select("id", F.coalesce("result", F.lit(0)).alias("result"), "hit")


@query(REQ + f"SELECT id, CASE WHEN id % 4 = 0 THEN 'TECHNICAL' ELSE category END AS category, id % 4 = 0 AS replaced FROM rq")
def second_pass(spark, sf):
    rows = _requirements(spark, sf)
    again = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "TECHNICAL").otherwise("UNKNOWN").alias("category"))
    return Q.second_pass(rows, again)


@query(REQ + "SELECT id, CASE WHEN id % 7 = 0 THEN 'NO_RESULT' WHEN id % 7 = 1 THEN 'EMPTY_SUMMARY' WHEN category IS NULL OR category = 'LEGAL' THEN 'BAD_CATEGORY' END AS refused FROM rq")
def model_gates(spark, sf):
    rows = _requirements(spark, sf).withColumn("summary", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, " ").otherwise(F.col("text"))).withColumn("category", F.when(F.col("id") % 7 != 0, F.col("category"))).withColumn("confidence", F.lit(0.5))
    return Q.gated(rows, ("SUBMISSION", "HSE", "QA_QC", "COMMERCIAL", "PERSONNEL", "SUBCONTRACTOR", "SCHEDULE", "TECHNICAL")).select("id", "refused")


@query(ALL + "SELECT id, document, id // 100 AS page, left(sentence, 200) AS quote FROM acc WHERE id % 2 = 0")
def provenance(spark, sf):
    rows = _accepted(spark, sf).withColumn("page", F.floor(F.col("id") / 100).cast("long"))
    results = rows.where("id % 2 = 0").select("id", F.lit("LEGAL").alias("category"), F.lit("said").alias("summary"), F.lit("other").alias("document"))
    return Q.with_provenance(results, rows).select("id", "document", "page", "quote")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 OR o_custkey % 10 = 0 OR o_orderkey = 1")
def visible_tenders(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("owner"))
    return U.visible(rows, 7, admin=True, shared=1).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 4 <> 1 AND o_custkey % 3 <> 1")
def active_tenders(spark, sf):
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "WON").alias("outcome"), F.when(k % 4 == 1, "CLOSED").when(k % 4 == 2, "OPEN").alias("stage"), F.when(k % 3 == 1, "NO_GO").when(k % 3 == 2, "GO").alias("decision"))
    return U.active(rows).select("id")


def _issues(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 3 == 0, "ANSWERED").otherwise("OPEN").alias("status"), F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("user_id") % 3 + 1).cast("int")).alias("priority"), F.col("ts").alias("at"))


@query("SELECT event_id AS id, event_type AS category, CASE WHEN event_id % 3 = 0 THEN 'ANSWERED' ELSE 'OPEN' END AS status FROM events ORDER BY event_id % 3 = 0, user_id % 3, ts, event_id LIMIT 200")
def issue_list(spark, sf):
    return U.issue_order(_issues(spark, sf), 200).select("id", "category", "status")


@query("SELECT event_type AS category, count(*) AS open FROM events WHERE event_id % 3 <> 0 AND event_type NOT IN ('click') GROUP BY 1")
def open_issue_counts(spark, sf):
    return _issues(spark, sf).where((F.col("status") == "OPEN") & ~F.col("category").isin("click")).groupBy("category").agg(F.count(F.lit(1)).alias("open"))


DEFAULTS = {"fit": 40.0, "price": 35.0, "risk": 25.0}


@query("""WITH w AS (SELECT s_suppkey AS id, least(greatest(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE s_acctbal END, 0), 100)::DOUBLE AS fit, least(greatest(CASE s_suppkey % 4 WHEN 0 THEN 0 ELSE 35 END, 0), 100)::DOUBLE AS price, least(greatest(CASE s_suppkey % 4 WHEN 0 THEN 0 ELSE s_nationkey END, 0), 100)::DOUBLE AS risk FROM supplier)
SELECT id, CASE WHEN fit + price + risk = 0 THEN 40 ELSE fit END AS fit, CASE WHEN fit + price + risk = 0 THEN 35 ELSE price END AS price, CASE WHEN fit + price + risk = 0 THEN 25 ELSE risk END AS risk FROM w""")
def cleaned_weights(spark, sf):
    k = F.col("s_suppkey") % 4
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "0").when(k == 1, "much").otherwise(F.col("s_acctbal").cast("string")).alias("fit"), F.when(k == 0, "-3").alias("price"), F.when(k == 0, "0").otherwise(F.col("s_nationkey").cast("string")).alias("risk"))
    return U.clean_weights(rows, DEFAULTS)


@query("SELECT l_partkey::VARCHAR AS code, count(*) AS rows, count(DISTINCT (l_quantity, l_linestatus, l_suppkey % 3)) AS variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_quantity, l_linestatus, l_suppkey % 3)) > 1")
def boq_conflicts(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("item"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("unit"), (F.col("l_suppkey") % 3).alias("price"), F.lit(None).cast("string").alias("total"))
    return U.boq_conflicts(rows)


SCAN = "s AS (SELECT source AS document, doc_id AS page, doc_id % 3 = 0 AS ocr, (doc_id % 100) / 100.0 AS confidence, coalesce(length(text), 0) AS chars FROM documents)"


def _scans(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(F.col("source").alias("document"), i.alias("page"), (i % 3 == 0).alias("ocr"), ((i % 100) / 100).alias("confidence"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


@query(f"WITH {SCAN}, b AS (SELECT document, list_sort(list_distinct(list(page))) AS p FROM s WHERE ocr AND (confidence < 0.55 OR chars < 30) GROUP BY 1) SELECT document, len(p) AS pages, array_to_string(p[1:20], ',') AS shown FROM b")
def unread_pages(spark, sf):
    return U.unread_pages(_scans(spark, sf))


STATUS = "d AS (SELECT o_orderkey AS document, o_custkey AS tender, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, CASE WHEN o_orderkey % 7 = 4 THEN 0 ELSE 10 END AS chars FROM orders)"


def _statuses(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 7
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("tender"), F.when(k == 1, "UNSUPPORTED").when(k == 2, "FAILED").when(k == 3, "PARTIAL").when(k > 3, "COMPLETE").alias("status"), F.when(k == 4, 0).otherwise(10).alias("chars"))


@query(f"WITH {STATUS} SELECT * FROM (SELECT document, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'UNSUPPORTED' THEN 'unsupported' WHEN status = 'FAILED' THEN 'failed' WHEN status = 'PARTIAL' THEN 'partly-read' WHEN chars = 0 THEN 'empty-text' END AS kind FROM d) WHERE kind IS NOT NULL")
def package_gaps(spark, sf):
    return U.package_gaps(_statuses(spark, sf)).select("document", "kind")


@query(f"WITH {STATUS} SELECT tender, count(*) AS documents, count(*) FILTER (status = 'COMPLETE') AS complete, round_even(100.0::DOUBLE * count(*) FILTER (status IN ('COMPLETE', 'PARTIAL')) / count(*), 1) AS percent, CASE WHEN count(*) FILTER (status = 'FAILED') = count(*) THEN 'FAILED' WHEN count(*) FILTER (status = 'COMPLETE') = count(*) THEN 'COMPLETE' ELSE 'PARTIAL' END AS state FROM d GROUP BY 1")
def coverage_state(spark, sf):
    return U.coverage(_statuses(spark, sf), "tender").select("tender", "documents", "complete", "percent", "state")


@query("SELECT o_custkey AS tender, o_orderpriority AS country, n AS mentions FROM (SELECT o_custkey, o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 1 END)::BIGINT AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 1 END) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def country_mode(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("tender"), F.col("o_orderpriority").alias("country"), F.when(F.col("o_orderstatus") == "F", 5).otherwise(1).cast("long").alias("weight"))
    return U.mentions_mode(rows, "tender", "country")


@query("SELECT l_orderkey AS tender, l_suppkey AS voter, arg_max(l_returnflag, (l_shipdate, l_linenumber % 2, l_linenumber)) AS vote FROM lineitem GROUP BY 1, 2")
def votes_upsert(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tender"), F.col("l_suppkey").alias("voter"), F.col("l_returnflag").alias("vote"), F.struct("l_shipdate", F.col("l_linenumber") % 2, "l_linenumber").alias("at"), F.col("l_linenumber").alias("n"))
    return U.latest_wins(rows.where("n % 2 = 0"), rows.where("n % 2 = 1"), ["tender", "voter"], "at").select("tender", "voter", "vote")


@query("SELECT l_partkey AS rfq, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 2 = 0 THEN l_orderkey * 10 + l_linenumber = max(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey) ELSE l_linenumber = 1 END AS selected FROM lineitem")
def exclusive_choice(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rfq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") == 1).alias("selected"))
    return U.chosen(rows, rows.where("rfq % 2 = 0").groupBy("rfq").agg(F.max("id").alias("chosen"))).select("rfq", "id", "selected")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS requirement, CASE WHEN l_partkey % 5 = 0 THEN 'ORPHAN' WHEN l_suppkey % 4 <> l_partkey % 4 THEN 'DRIFT' END AS refused FROM lineitem")
def drift_guard(spark, sf):
    chunk = lambda c: F.format_string("chunk-%04d-seg-%02d", (F.col(c) % 4).cast("int"), F.lit(1))
    lines = table(spark, sf, "lineitem")
    rows = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("requirement"), chunk("l_suppkey").alias("chunk"))
    return U.drifted(rows, lines.select(F.col("l_partkey").alias("requirement"), chunk("l_partkey").alias("chunk")).distinct().where("requirement % 5 <> 0"))


@query("SELECT 'tender' AS kind, o_orderkey AS id, o_orderdate::DATE AS at FROM orders UNION ALL SELECT 'company', c_custkey, NULL FROM customer")
def file_union(spark, sf):
    tender = table(spark, sf, "orders").select(F.lit("tender").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at"))
    company = table(spark, sf, "customer").select(F.lit("company").alias("kind"), F.col("c_custkey").alias("id"))
    return tender.unionByName(company, allowMissingColumns=True)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || '#p1' END AS name, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS page FROM documents")
def evidence_pointers(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("#p1#p"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", text.alias("pointer")).withColumn("p", R.pointer(F.col("pointer"))).select("doc_id", "p.name", F.coalesce(F.col("p.page").cast("long"), F.lit(0)).alias("page"))


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS events, coalesce(avg(value) FILTER (event_type = 'error') > 0, false) AS failing FROM events GROUP BY 1")
def json_fields(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.avg(F.when(F.col("event_type") == "error", F.col("value"))) > 0, F.lit(False)).alias("failing"))


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_trail(spark, sf):
    """Events appended by date, read again newest first."""
    from paperloom.streaming.events import shared_folder

    path = shared_folder(spark)
    table(spark, sf, "events").withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").parquet(path)
    return spark.read.parquet(path).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "ts", "user_id")
