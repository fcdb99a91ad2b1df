"""Queries on decisions, portfolio and materials over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import decisions, materials, portfolio
from paperloom.sources.tables import evidence, prices, quotations, requirements, risks, table, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return decisions.requirement_status(requirements(lines), evidence(lines))


STATUS = with_sql("requirement", "evidence", "status")


@query(STATUS + "SELECT tender_id, line, category, mandatory, requirement_type, n_evidence, status FROM status")
def requirement_status(spark, sf):
    return statuses(spark, sf).drop("part")


@query(with_sql("requirement", "evidence", "status", "decision") + """, blocked AS (SELECT tender_id, o, line, t, row_number() OVER (PARTITION BY tender_id ORDER BY o, line) AS nth FROM (
SELECT tender_id, line, CASE WHEN requirement_type <> 'HARD_GATE' AND status = 'FAIL' THEN 0 WHEN status IN ('MISSING_EVIDENCE', 'REVIEW') THEN 1 END AS o,
 concat(category, '/', line, CASE WHEN status = 'FAIL' THEN ' [CONTRADICTED]' WHEN status = 'REVIEW' THEN ' [REVIEW]' ELSE '' END) AS t FROM status WHERE mandatory) WHERE o IS NOT NULL),
b AS (SELECT tender_id, string_agg(t, '; ' ORDER BY o, line) AS blockers FROM blocked WHERE nth <= 6 GROUP BY 1)
SELECT r.*, CASE rule WHEN 'HARD_GATE_FAIL' THEN 'NO_BID' WHEN 'ALL_MANDATORY_PASS' THEN 'BID' ELSE 'REVIEW' END AS decision,
 CASE WHEN rule IN ('HARD_GATE_FAIL', 'ALL_MANDATORY_PASS') THEN 'HIGH' WHEN rule = 'COMMERCIAL_RISK_REVIEW' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, coalesce(blockers, '') AS blockers
FROM ruled r LEFT JOIN b USING (tender_id)""")
def tender_decision(spark, sf):
    orders = table(spark, sf, "orders")
    return decisions.tender_decision(orders.select(F.col("o_orderkey").alias("tender_id")), statuses(spark, sf), risks(orders))


@query(STATUS + """SELECT tender_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'REVIEW') AS n_review, count(*) FILTER (status = 'MISSING_EVIDENCE') AS n_missing_evidence, count(*) AS n,
round_even(100.0::DOUBLE * count(*) FILTER (status = 'PASS') / count(*), 0) AS percent FROM status WHERE mandatory GROUP BY 1""")
def compliance_counts(spark, sf):
    return decisions.compliance(statuses(spark, sf))


@query(STATUS + """SELECT tender_id, count(*) FILTER (requirement_type = 'HARD_GATE' AND status = 'FAIL') AS hard_failures, count(*) FILTER (status IN ('MISSING_EVIDENCE', 'REVIEW')) AS gaps, count(*) FILTER (status IN ('PASS', 'FAIL')) AS supporting, sum(n_evidence)::BIGINT AS evidence FROM status GROUP BY 1""")
def decision_explain_counts(spark, sf):
    return decisions.explanation(statuses(spark, sf))


@query(STATUS + """SELECT tender_id, line, s.category, status, coalesce(priority, CASE WHEN mandatory THEN 'HIGH' ELSE 'MEDIUM' END) AS priority, coalesce(owner, 'Bid manager') AS owner
FROM status s LEFT JOIN (VALUES ('LEGAL', 'HIGH', 'Legal'), ('FINANCIAL', 'HIGH', 'Finance'), ('PERSONNEL', 'MEDIUM', 'Human resources'), ('HSE', 'MEDIUM', 'HSE')) l(category, priority, owner) ON l.category = s.category WHERE status IN ('MISSING_EVIDENCE', 'REVIEW')""")
def missing_evidence(spark, sf):
    lookup = spark.createDataFrame([("LEGAL", "HIGH", "Legal"), ("FINANCIAL", "HIGH", "Finance"), ("PERSONNEL", "MEDIUM", "Human resources"), ("HSE", "MEDIUM", "HSE")], "category string, priority string, owner string")
    return decisions.missing_evidence(statuses(spark, sf), lookup)


RANK = "CASE status WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'MISSING_EVIDENCE' THEN 2 ELSE 3 END"


@query(STATUS + f"SELECT * FROM (SELECT tender_id, row_number() OVER (PARTITION BY tender_id ORDER BY {RANK}, line) AS position, line, category, status FROM status WHERE status <> 'PASS') WHERE position <= 15")
def gap_list(spark, sf):
    return decisions.gap_list(statuses(spark, sf))


@query(STATUS + f"SELECT tender_id, line, category, mandatory, status, row_number() OVER (PARTITION BY tender_id ORDER BY mandatory DESC, {RANK}, category, line) AS position FROM status")
def decision_detail(spark, sf):
    return decisions.decision_detail(statuses(spark, sf))


@query(with_sql("requirement", "evidence", "status", "decision") + """, f AS (SELECT tender_id, gate_fail > 0 AS hard_fail, (100 - 10 * least(gaps, 10))::DOUBLE AS fit FROM ruled),
g AS (SELECT f.*, CASE WHEN o_totalprice > 100000 THEN 80.0 WHEN o_totalprice > 20000 THEN 50.0 END::DOUBLE AS history, CASE o_orderpriority WHEN '1-URGENT' THEN 30.0 WHEN '2-HIGH' THEN 60.0 WHEN '5-LOW' THEN NULL ELSE 90.0 END::DOUBLE AS votes FROM f JOIN orders ON o_orderkey = tender_id),
s AS (SELECT tender_id, hard_fail, 40.0 + CASE WHEN history IS NULL THEN 0.0 ELSE 20.0 END + CASE WHEN votes IS NULL THEN 0.0 ELSE 25.0 END AS weight, 40 * fit + coalesce(20 * history, 0) + coalesce(25 * votes, 0) AS total FROM g)
SELECT tender_id, round_even(total / weight::DOUBLE, 0)::BIGINT AS score, weight::DOUBLE AS weight, CASE WHEN hard_fail THEN 'NO_GO' WHEN round_even(total / weight::DOUBLE, 0) >= 70 THEN 'GO' WHEN round_even(total / weight::DOUBLE, 0) >= 50 THEN 'REVIEW' ELSE 'NO_GO' END AS band FROM s""")
def weighted_score(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "tender_id")
    rows = tender_decision(spark, sf).join(orders, "tender_id")
    history = F.when(F.col("o_totalprice") > 100000, 80.0).when(F.col("o_totalprice") > 20000, 50.0)
    votes = F.when(F.col("o_orderpriority") == "1-URGENT", 30.0).when(F.col("o_orderpriority") == "2-HIGH", 60.0).when(F.col("o_orderpriority") != "5-LOW", 90.0)
    fit = (100 - 10 * F.least("gaps", F.lit(10))).cast("double")
    factor = lambda name, value, w: F.struct(F.lit(name).alias("factor"), value.cast("double").alias("value"), F.lit(w).alias("weight"))
    long = rows.select("tender_id", (F.col("gate_fail") > 0).alias("hard_fail"), F.explode(F.array(factor("fit", fit, 40.0), factor("history", history, 20.0), factor("votes", votes, 25.0))).alias("f"))
    return decisions.weighted_score(long.select("tender_id", "hard_fail", "f.*"))


VOTES = "CASE event_type WHEN 'click' THEN 'APPROVE' WHEN 'error' THEN 'REJECT' ELSE 'ABSTAIN' END"


@query(f"""SELECT user_id % 20 AS tender_id, d AS department, count(*) FILTER (vote = 'APPROVE') AS approve, count(*) FILTER (vote = 'REJECT') AS reject, count(*) FILTER (vote = 'ABSTAIN') AS abstain,
round_even(100.0::DOUBLE * count(*) FILTER (vote = 'APPROVE') / nullif(count(*) FILTER (vote IN ('APPROVE', 'REJECT')), 0), 0) AS percent
FROM (SELECT *, concat('D', user_id % 7) AS d, {VOTES} AS vote FROM events WHERE event_type IN ('click', 'error', 'view')) GROUP BY GROUPING SETS ((user_id % 20), (user_id % 20, d))""")
def vote_summary(spark, sf):
    vote = F.when(F.col("event_type") == "click", "APPROVE").when(F.col("event_type") == "error", "REJECT").otherwise("ABSTAIN")
    rows = table(spark, sf, "events").where(F.col("event_type").isin("click", "error", "view"))
    return portfolio.vote_summary(rows.select((F.col("user_id") % 20).alias("tender_id"), F.concat(F.lit("D"), F.col("user_id") % 7).alias("department"), vote.alias("vote")))


OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'WON' WHEN 'O' THEN 'LOST' END"


def _outcomes(spark, sf):
    outcome = F.when(F.col("o_orderstatus") == "F", "WON").when(F.col("o_orderstatus") == "O", "LOST")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), outcome.alias("outcome"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_totalprice", F.col("o_orderkey").alias("tender_id"))


WINS = "count(*) AS tenders, count(*) FILTER (outcome = 'WON') AS won, count(*) FILTER (outcome = 'LOST') AS lost, round_even(100.0::DOUBLE * count(*) FILTER (outcome = 'WON') / nullif(count(*) FILTER (outcome IN ('WON', 'LOST')), 0), 0) AS win_rate"


@query(f"SELECT o_custkey AS client, {WINS} FROM (SELECT *, {OUTCOME} AS outcome FROM orders) GROUP BY 1")
def win_rate_by_client(spark, sf):
    return portfolio.win_rate(_outcomes(spark, sf), "client")


@query(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {WINS} FROM (SELECT *, {OUTCOME} AS outcome FROM orders) GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def portfolio_analytics(spark, sf):
    return portfolio.win_rate(_outcomes(spark, sf), "month").orderBy(F.col("month").desc()).limit(12)


@query(f"SELECT o_custkey AS client, {WINS} FROM (SELECT *, {OUTCOME} AS outcome FROM orders) GROUP BY 1 ORDER BY won DESC, tenders DESC, client LIMIT 8")
def top_clients(spark, sf):
    return portfolio.win_rate(_outcomes(spark, sf), "client").orderBy(F.col("won").desc(), F.col("tenders").desc(), "client").limit(8)


HISTORY = """h AS (SELECT p_brand AS discipline, lower(s_name) AS supplier, count(*) AS quotes, count(*) FILTER (l_returnflag = 'A') AS selected, round_even(sum((100 * (1 - l_discount))::DECIMAL(12,4)) / count(*), 2)::DOUBLE AS avg_fit, count(DISTINCT l_orderkey) AS tenders
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def _history(spark, sf):
    lines, part, supplier = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return portfolio.supplier_history(rows.select(F.col("p_brand").alias("discipline"), F.lower("s_name").alias("supplier"), (F.col("l_returnflag") == "A").alias("selected"), (100 * (1 - F.col("l_discount"))).alias("fit"), F.col("l_orderkey").alias("tender_id")))


@query(f"WITH {HISTORY} SELECT * FROM h")
def supplier_history(spark, sf):
    return _history(spark, sf)


@query(f"WITH {HISTORY} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY discipline ORDER BY selected DESC, avg_fit DESC, quotes DESC, supplier) AS position FROM h) WHERE position <= 5")
def supplier_top5(spark, sf):
    return portfolio.top_suppliers(_history(spark, sf))


@query(with_sql("requirement", "evidence", "status", "decision") + f""", w AS (SELECT o_custkey AS client, {WINS} FROM (SELECT *, {OUTCOME} AS outcome FROM orders) GROUP BY 1)
SELECT r.tender_id, c_name AS client, n_name AS country, rule, gaps, win_rate FROM ruled r JOIN orders ON o_orderkey = r.tender_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN w ON w.client = o_custkey""")
def board(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("key"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("client"), "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    wins = win_rate_by_client(spark, sf).select(F.col("client").alias("key"), "win_rate")
    rows = tender_decision(spark, sf).select("tender_id", "rule", "gaps").join(orders, "tender_id").join(customer, "key", "left").join(nation, "c_nationkey", "left").join(wins, "key", "left")
    return rows.select("tender_id", "client", "country", "rule", "gaps", "win_rate")


@query(with_sql("requirement", "evidence", "status", "decision") + "SELECT o_orderpriority AS stage, count(*) AS tenders, count(*) FILTER (rule = 'HARD_GATE_FAIL') AS blocked, count(*) FILTER (rule LIKE 'MANDATORY_GATE%') AS awaiting FROM ruled JOIN orders ON o_orderkey = tender_id GROUP BY 1")
def attention(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderpriority").alias("stage"))
    rows = tender_decision(spark, sf).join(orders, "tender_id")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.col("rule") == "HARD_GATE_FAIL").alias("blocked"), F.count_if(F.col("rule").like("MANDATORY_GATE%")).alias("awaiting"))


PRICES = """p AS (SELECT l_partkey AS key, l_suppkey AS supplier, l_shipdate::DATE AS price_date, CASE WHEN l_quantity <= 10 THEN 0.0 ELSE l_quantity END::DOUBLE AS min_qty, l_extendedprice / l_quantity AS price, l_orderkey AS offer, l_linenumber AS line FROM lineitem),
f AS (SELECT key, supplier, price_date FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price_date DESC, offer, line, price) AS nth FROM p) WHERE nth = 1),
n AS (SELECT p.* FROM p JOIN f USING (key, supplier, price_date)),
c AS (SELECT key, price, supplier, price_date FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY min_qty, price, supplier, offer, line) AS nth FROM n) WHERE nth = 1),
d AS (SELECT l_partkey AS key, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
b AS (SELECT key, d.quantity, min(price) AS bulk_price FROM d JOIN n USING (key) WHERE min_qty > 0 AND min_qty <= d.quantity GROUP BY 1, 2),
x AS (SELECT l_orderkey AS tender_id, l_linenumber AS line, l_partkey AS key, l_quantity AS quantity, price, (l_quantity * price)::DECIMAL(24,8)::DECIMAL(20,2)::DOUBLE AS cost, CASE WHEN price IS NULL THEN 'PRICE_UNAVAILABLE' ELSE 'PRICED' END AS status FROM lineitem LEFT JOIN (SELECT * FROM c WHERE key % 10 <> 0) c ON key = l_partkey)"""


def _prices(spark, sf):
    return prices(table(spark, sf, "lineitem"))


def _demand(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("quantity"))


def _costs(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("key"), F.col("l_quantity").alias("quantity"))
    return materials.boq_cost(lines, materials.current_price(_prices(spark, sf)).where("key % 10 <> 0"))


@query(f"WITH {PRICES} SELECT * FROM c")
def current_price(spark, sf):
    return materials.current_price(_prices(spark, sf))


@query(f"WITH {PRICES} SELECT * FROM b")
def bulk_price(spark, sf):
    return materials.bulk_price(_demand(spark, sf), _prices(spark, sf))


@query(f"WITH {PRICES} SELECT * FROM x")
def boq_cost(spark, sf):
    return _costs(spark, sf)


@query(f"WITH {PRICES} SELECT (key % 3)::BIGINT AS currency, sum(cost::DECIMAL(24,8))::DECIMAL(20,2)::DOUBLE AS total, count(price) AS priced, count(*) FILTER (price IS NULL) AS unpriced FROM x GROUP BY 1")
def cost_by_currency(spark, sf):
    return materials.cost_by(_costs(spark, sf).withColumn("currency", F.col("key") % 3), "currency")


@query(f"""WITH {PRICES}, y AS (SELECT key, count(DISTINCT tender_id) AS tenders, sum(quantity) AS quantity, sum(cost::DECIMAL(24,8))::DECIMAL(20,2)::DOUBLE AS cost FROM x GROUP BY 1 HAVING count(DISTINCT tender_id) >= 2)
SELECT y.*, bulk_price, y.quantity * bulk_price AS scenario, cost - y.quantity * bulk_price AS difference FROM y LEFT JOIN b USING (key)""")
def bulk_materials(spark, sf):
    return materials.bulk_materials(_costs(spark, sf), bulk_price(spark, sf))


@query("SELECT p_brand AS family, count(DISTINCT p_partkey) AS keys, count(DISTINCT l_orderkey) AS tenders FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1 AND count(DISTINCT l_orderkey) > 1")
def review_materials(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("p_brand").alias("family")).agg(F.countDistinct("p_partkey").alias("keys"), F.countDistinct("l_orderkey").alias("tenders")).where("keys > 1 and tenders > 1")


@query("""WITH q AS (SELECT l_partkey AS rfq, l_suppkey AS contractor, l_orderkey AS offer, l_linenumber AS duration, l_extendedprice / l_quantity AS price, 100 * (1 - l_discount) AS fit, l_tax * 1000 AS terms FROM lineitem),
s AS (SELECT *, round_even(100 * (0.0::DOUBLE + 0.4::DOUBLE * (least(greatest(fit, 0), 100) / 100) + 0.3::DOUBLE * (min(price) OVER (PARTITION BY rfq) / price) + 0.2::DOUBLE * (min(duration) OVER (PARTITION BY rfq) / duration) + 0.1::DOUBLE * coalesce(terms / nullif(max(terms) OVER (PARTITION BY rfq), 0), 0)), 1) AS score, fit >= 60 AS eligible FROM q)
SELECT rfq, contractor, offer, duration, score, eligible, eligible AND row_number() OVER (PARTITION BY rfq, eligible ORDER BY score DESC, contractor, offer, duration, price) = 1 AS best FROM s""")
def quotation_score(spark, sf):
    return materials.score_quotations(quotations(table(spark, sf, "lineitem")))


@query("SELECT user_id AS job, event_type AS stage, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_state(spark, sf):
    return portfolio.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "event_id", "ts")


SECONDS = "floor(epoch(ts))::BIGINT"


@query(f"SELECT event_id, user_id, recent, recent > 3 AS blocked FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')")
def resume_limit(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'")
    return portfolio.within_limit(rows, "user_id", 6 * 3600, 3).select("event_id", "user_id", "recent", "blocked")


@query(f"SELECT event_id, user_id, recent, recent > 9 AS blocked FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def rate_limit(spark, sf):
    return portfolio.within_limit(table(spark, sf, "events"), "user_id", 900, 9).select("event_id", "user_id", "recent", "blocked")


@query("""SELECT event_type, any_value(n)::BIGINT AS n, max(CASE WHEN k = least(floor(n * 0.5), n - 1) THEN value END) AS p50, max(CASE WHEN k = least(floor(n * 0.95), n - 1) THEN value END) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def latency_p95(spark, sf):
    return portfolio.index_percentile(table(spark, sf, "events"), ["event_type"], "value", 0.5, 0.95)


@query("""SELECT 'audit' AS kind, event_id AS id, ts AS "at", user_id AS actor FROM events WHERE event_type = 'signup' UNION ALL SELECT 'override', event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY "at" DESC, id DESC LIMIT 200""")
def audit_union(spark, sf):
    events = table(spark, sf, "events")
    pick = lambda kind, name: events.where(F.col("event_type") == kind).select(F.lit(name).alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("actor"))
    return pick("signup", "audit").unionByName(pick("purchase", "override")).orderBy(F.col("at").desc(), F.col("id").desc()).limit(200)


@query("""WITH p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 400), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
n AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g USING (doc_id))
SELECT *, coalesce(round_even(tp::DOUBLE / nullif(tp + fp, 0), 4), 0.0) AS precision, coalesce(round_even(tp::DOUBLE / nullif(tp + fn, 0), 4), 0.0) AS recall, coalesce(round_even(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4), 0.0) AS f1 FROM n""")
def prf(spark, sf):
    return portfolio.scores_of_sets(table(spark, sf, "documents").where("n_chars > 400"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("""WITH p AS (SELECT CASE WHEN n_chars > 400 THEN 'good' ELSE 'poor' END AS predicted, CASE WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' ELSE 'good' END AS gold FROM documents JOIN labels USING (doc_id)),
c AS (SELECT class, count(*) FILTER (predicted = class AND gold = class) AS tp, count(*) FILTER (predicted = class AND gold <> class) AS fp, count(*) FILTER (predicted <> class AND gold = class) AS fn FROM p, (VALUES ('good'), ('poor'), ('toxic'), ('spam')) v(class) GROUP BY 1),
f AS (SELECT *, round_even(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM c)
SELECT *, round_even(avg(f1) OVER (), 4) AS macro_f1 FROM f""")
def macro_f1(spark, sf):
    gold = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("good")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return portfolio.macro_f1(rows.select(F.when(F.col("n_chars") > 400, "good").otherwise("poor").alias("predicted"), gold.alias("gold")), ["good", "poor", "toxic", "spam"])
