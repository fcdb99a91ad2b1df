"""Queries on page text over the documents table, with their SQL.

The documents hold invented prose, so each page gets one clause of procurement language by doc_id, and
every second page of a source a common header, in the query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import candidates, cosine, facts, pages, similarity
from paperloom.sources.tables import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CLAUSES = (
    "SECTION 4 - COMMERCIAL\nBids shall remain valid for 90 days from the closing date.",
    "This offer shall remain valid for 120 days. The bid bond is due on 12/02/2024.",
    "The performance bond shall be 10% of the Contract Price, see Annex B-2.",
    "SECTION 5 - SCHEDULE\nDelivery is to be confirmed. It shall start within 3 weeks from award.",
    "Bidder shall submit an ISO 9001 certificate with the bid, see Form 3.",
    "The 220 kV GIS transformer of 175 MVA needs type test reports and voltage records, see 32-TMSS-01 and 01 - tmss - 02.",
    "Liquidated damages apply for delay, limited to 10%. Performance security equal to 5% of the price. The completion period is 18 months.",
    "Health and safety plans and key personnel must be named within 30 days after signature. The contract period shall be 80 weeks; recover 3% retention per week.",
    "Payment of SAR 1,250,000 follows audited turnover and working capital figures.",
    "XLPE Cu cable 4x16 mm2 0.6/1 kV | m | 12,000\nCircuit breaker 3x400 A | no | 20",
    "PART II\nXLPE cable 4x16 mm2 1 kV | km | 8\nRefer to APPENDIX 7 and Annexure C.",
    "The subcontractor joint venture pays twenty six percent (13%) of the retention of 10% by 20/22/2024.",
)
HEADER = "TENDER DOCUMENT PACKAGE"


def _text_sql() -> str:
    held = ", ".join("'" + c.replace("'", "''") + "'" for c in CLAUSES)
    return f"(CASE WHEN doc_id % 2 = 0 THEN '{HEADER}' || chr(10) ELSE '' END) || text || chr(10) || ([{held}])[(doc_id % 12 + 1)::INT]"


PAGES = f"pages_ AS (SELECT source AS document, doc_id AS page, {_text_sql()} AS text FROM documents)"
SENTENCES = r"""lines_ AS (SELECT document, page, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM pages_),
parts_ AS (SELECT document, page, text, line, unnest(string_split(regexp_replace(body, '([.;?!])\s+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(body, '([.;?!])\s+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) - 1 AS n FROM lines_),
sent AS (SELECT document, page, line, n, trim(s) AS sentence, text FROM parts_ WHERE trim(s) <> '')"""


def _signal_sql() -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(lower(sentence), '{p}') THEN '{c}' END" for c, p in T.SIGNALS)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def _first_sql(column: str, cascade) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in cascade) + " END"


def _form_sql(column: str) -> str:
    return rf"trim(regexp_replace(translate(lower({column}), '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\s+', ' ', 'g'))"


# signals keep the first of each category; only COMMERCIAL stands twice among the patterns
FOUND = f"""h AS (SELECT *, {_signal_sql()} AS raw FROM sent WHERE length(trim(text)) >= 300),
hits AS (SELECT document, page, line, n, sentence, list_filter(raw, lambda x, i: NOT list_contains(raw[1:i - 1], x)) AS sig FROM h),
ladder AS (SELECT *, CASE WHEN length(sentence) < 20 THEN 'REJECTED_TINY' WHEN (length(regexp_replace(sentence, '[\\p{{C}}\\p{{Z}}]', '', 'g')) + length(sentence) - length(translate(sentence, ' ' || chr(10) || chr(9), '')))::DOUBLE / length(sentence) < 0.7 THEN 'REJECTED_OCR_GARBAGE' WHEN len(sig) = 0 THEN 'REJECTED_NO_SIGNAL' WHEN len(sig) > 2 THEN 'REJECTED_MIXED_MULTI' END AS r FROM hits),
seqd AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY document, page, r IS NULL ORDER BY line, n) END AS k FROM ladder),
cand AS (SELECT document, page, line, n, sentence, array_to_string(sig, ',') AS signals, CASE WHEN r IS NOT NULL THEN r WHEN k > 20 THEN 'over_parent_cap' END AS reason, CASE WHEN k <= 20 THEN k END AS seq FROM seqd
UNION ALL SELECT document, page, 0, 0, '', '', 'SKIPPED_TINY_INPUT', NULL FROM pages_ WHERE length(trim(text)) < 300),
acc AS (SELECT document, page * 100 + seq AS id, sentence, signals FROM cand WHERE reason IS NULL)"""
ALL = f"WITH {PAGES}, {SENTENCES}, {FOUND}\n"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    clause = F.element_at(F.array(*map(F.lit, CLAUSES)), (F.col("doc_id") % 12 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 2 == 0, F.lit(HEADER + "\n")).otherwise("")
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text")).select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.concat(head, "text", F.lit("\n"), clause).alias("text"))


def _accepted(spark, sf) -> DataFrame:
    rows = candidates.discover(page_rows(spark, sf), rejects=False)
    return rows.select("document", (F.col("page") * 100 + F.col("seq")).alias("id"), "sentence", "signals")


@query(f"WITH {PAGES}, {SENTENCES} SELECT document, page, line, trim(body) AS text FROM lines_ WHERE trim(body) <> ''")
def page_lines(spark, sf):
    return pages.lines(page_rows(spark, sf)).select("document", "page", F.col("pos").alias("line"), F.col("line").alias("text"))


@query(f"WITH {PAGES}, {SENTENCES} SELECT document, page, line, n, sentence FROM sent")
def sentences(spark, sf):
    return page_rows(spark, sf).select("document", "page", F.inline(T.sentences(F.col("text"))))


@query(ALL + "SELECT page, line, n, signals, reason FROM cand WHERE reason IS NOT NULL")
def candidate_rejects(spark, sf):
    return candidates.discover(page_rows(spark, sf)).where("reason is not null").select("page", "line", "n", "signals", "reason")


@query(ALL + "SELECT page, line, n, signals, seq, sentence FROM cand WHERE reason IS NULL")
def accepted_candidates(spark, sf):
    return candidates.discover(page_rows(spark, sf), rejects=False).select("page", "line", "n", "signals", "seq", "sentence")


@query(ALL + "SELECT reason, count(*) AS rows FROM cand WHERE reason IS NOT NULL AND reason <> 'over_parent_cap' GROUP BY 1")
def reject_histogram(spark, sf):
    return candidates.discover(page_rows(spark, sf)).where("reason is not null and reason <> 'over_parent_cap'").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query(ALL + "SELECT document, id, min(id) OVER (PARTITION BY document, sentence) AS kept_id FROM acc")
def exact_dedup(spark, sf):
    return candidates.exact_duplicates(_accepted(spark, sf)).select("document", "id", "kept_id")


@query(ALL + f"SELECT document, id, min(id) OVER (PARTITION BY document, {_form_sql('sentence')}) AS kept_id FROM acc")
def normalized_dedup(spark, sf):
    return candidates.normalized_duplicates(_accepted(spark, sf)).select("document", "id", "kept_id")


@query(ALL + f"SELECT {_form_sql('sentence')} AS form, count(DISTINCT document) AS documents, count(*) AS rows, min(id) AS first_id FROM acc GROUP BY 1 HAVING count(DISTINCT document) > 1")
def duplicate_groups(spark, sf):
    return candidates.duplicate_groups(_accepted(spark, sf))


@query(ALL + f"""SELECT count(*) AS raw, count(*) - count(DISTINCT (document, sentence)) AS exact, count(DISTINCT (document, sentence)) - count(DISTINCT (document, {_form_sql('sentence')})) AS normalized, count(DISTINCT (document, {_form_sql('sentence')})) AS final,
round_even(100.0::DOUBLE * (count(*) - count(DISTINCT (document, {_form_sql('sentence')}))) / count(*), 2) AS reduction FROM acc""")
def dedup_metrics(spark, sf):
    rows = _accepted(spark, sf).select(F.struct("document", "sentence").alias("a"), F.struct("document", T.normal_form(F.col("sentence"))).alias("b"))
    n = rows.agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("a").alias("x"), F.countDistinct("b").alias("final"))
    return n.select("raw", (F.col("raw") - F.col("x")).alias("exact"), (F.col("x") - F.col("final")).alias("normalized"), "final", F.bround(100.0 * (F.col("raw") - F.col("final")) / F.col("raw"), 2).alias("reduction"))


@query(ALL + "SELECT document, id, position, position > 20 AS dropped FROM (SELECT document, id, row_number() OVER (PARTITION BY document ORDER BY len(string_split(signals, ',')) DESC, length(sentence) DESC, id) AS position FROM acc)")
def work_queue(spark, sf):
    return candidates.work_queue(_accepted(spark, sf), 20).select("document", "id", "position", "dropped")


@query(ALL + "SELECT document, format('REQ-{:06d}', row_number() OVER (PARTITION BY document ORDER BY id)) AS requirement, id FROM acc")
def canonical_ids(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("document").orderBy("id"))
    return _accepted(spark, sf).select("document", F.format_string("REQ-%06d", nth).alias("requirement"), "id")


@query(ALL + f"SELECT document, id, {_first_sql('sentence', T.WORK_TYPES)} AS work_type FROM acc")
def kind_of(spark, sf):
    return _accepted(spark, sf).select("document", "id", T.first_of(F.col("sentence"), T.WORK_TYPES).alias("work_type"))


@query(ALL + f"SELECT document, work_type, n FROM (SELECT document, {_first_sql('sentence', T.WORK_TYPES)} AS work_type, count(*) AS n, row_number() OVER (PARTITION BY document ORDER BY count(*) DESC, {_first_sql('sentence', T.WORK_TYPES)}) AS k FROM acc WHERE {_first_sql('sentence', T.WORK_TYPES)} IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def kind_mode(spark, sf):
    from pyspark.sql import Window

    rows = kind_of(spark, sf).where("work_type is not null").groupBy("document", "work_type").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("document").orderBy(F.col("n").desc(), "work_type"))
    return rows.withColumn("k", nth).where("k = 1").drop("k")


LINES = f"WITH {PAGES}, {SENTENCES}, ln AS (SELECT document, page, line AS pos, trim(body) AS line FROM lines_ WHERE trim(body) <> '')\n"


@query(LINES + "SELECT document, line, count(DISTINCT page) AS on_pages, pages FROM ln JOIN (SELECT document, count(DISTINCT page) AS pages FROM ln GROUP BY 1) USING (document) GROUP BY document, line, pages HAVING pages >= 4 AND count(DISTINCT page) >= greatest(3.0, pages * 0.3)")
def repeated_lines(spark, sf):
    return pages.repeated_lines(pages.lines(page_rows(spark, sf)))


OWN = f"own AS (SELECT document, page, arg_max(CASE WHEN t <> '' THEN t END, CASE WHEN t <> '' THEN pos END) AS own FROM (SELECT *, regexp_extract(line, '{T.HEADING}', 1) AS t FROM ln) GROUP BY 1, 2)"


@query(LINES + f", {OWN} SELECT document, page, last_value(own IGNORE NULLS) OVER (PARTITION BY document ORDER BY page ROWS UNBOUNDED PRECEDING) AS heading FROM own")
def heading_in_effect(spark, sf):
    return pages.heading_in_effect(pages.lines(page_rows(spark, sf)))


@query(LINES + f""", ti AS (SELECT document, regexp_extract(line, '{T.HEADING}', 1) AS title, min(page) AS f FROM ln WHERE regexp_extract(line, '{T.HEADING}', 1) <> '' GROUP BY 1, 2), en AS (SELECT document, max(page) AS l FROM ln GROUP BY 1)
SELECT document, title, f AS "from", greatest(coalesce(lead(f) OVER (PARTITION BY document ORDER BY f, title) - 1, l), f) AS "to" FROM ti JOIN en USING (document)""")
def section_ranges(spark, sf):
    return pages.section_ranges(pages.lines(page_rows(spark, sf)))


@query("""SELECT source, lang, min(page) AS "from", max(page) AS "to", count(*) AS pages FROM (SELECT *, page - row_number() OVER (PARTITION BY source, lang ORDER BY page) AS island FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)) GROUP BY source, lang, island""")
def page_ranges(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return pages.page_ranges(table(spark, sf, "documents").select("source", "lang", nth.alias("page")), "source", "lang")


def _facts_sql() -> str:
    factor = {"completion": "CASE lower(u) WHEN 'weeks' THEN 7 WHEN 'months' THEN 30 ELSE 1 END", "warranty": "CASE lower(u) WHEN 'years' THEN 12 ELSE 1 END"}
    return " UNION ALL ".join(f"SELECT document, page, '{f}' AS fact, v::DOUBLE * ({factor.get(f, 1)}) AS value, q FROM (SELECT document, page, q, unnest(regexp_extract_all(sentence, '{p}', 1)) AS v, unnest(regexp_extract_all(sentence, '{p}', 2)) AS u FROM said)" for f, _, p in T.FACTS)


QUOTE = r"left(regexp_replace(sentence, '\s+', ' ', 'g'), 300)"


@query(f"WITH {PAGES}, {SENTENCES}, said AS (SELECT *, {QUOTE} AS q FROM sent WHERE NOT regexp_matches(sentence, '{T.FACT_SKIP}')), fa AS ({_facts_sql()}) SELECT fact, value, count(DISTINCT document) AS documents, min(page) AS first_page, arg_min(q, (page, document, q)) AS quote FROM fa WHERE fact IN (SELECT fact FROM fa GROUP BY 1 HAVING count(DISTINCT value) > 1 AND count(DISTINCT document) > 1) GROUP BY 1, 2")
def fact_conflicts(spark, sf):
    return facts.fact_conflicts(facts.facts(page_rows(spark, sf)))


@query(f"""WITH {PAGES}, {SENTENCES}, g AS (SELECT document, page, {QUOTE} AS quote, unnest(regexp_extract_all(sentence, '{T.NUMBER_WORDS}', 1)) AS w, unnest(regexp_extract_all(sentence, '{T.NUMBER_WORDS}', 2)) AS u, unnest(regexp_extract_all(sentence, '{T.NUMBER_WORDS}', 3))::INT AS digits, unnest(regexp_extract_all(sentence, '{T.NUMBER_WORDS}', 4)) AS v FROM sent),
m AS (SELECT *, CASE WHEN lower(w) IN ('hundred', 'one hundred', 'one-hundred') THEN 100 ELSE list_sum(list_transform(string_split_regex(lower(w), '[ -]'), lambda x: map({list(T.ONES) + list(T.TENS)}, {[*range(20), *range(20, 100, 10)]})[x]))::INT END AS number FROM g)
SELECT arg_min(document, (page, document)) AS document, min(page) AS page, arg_min(lower(w), (page, document)) AS words, arg_min(number, (page, document)) AS number, arg_min(digits, (page, document)) AS digits, quote FROM m WHERE number <> digits AND (u <> '' OR v <> '') GROUP BY quote""")
def words_vs_digits(spark, sf):
    return facts.words_vs_digits(page_rows(spark, sf))


@query(f"""WITH {PAGES}, g AS (SELECT document, page, list_filter(regexp_extract_all(text, '{T.DATE}', 1), lambda d: string_split_regex(d, '[/-]')[1]::INT BETWEEN 1 AND 31 AND string_split_regex(d, '[/-]')[2]::INT BETWEEN 1 AND 12) AS ds FROM pages_)
SELECT * FROM (SELECT document, page, unnest(ds) AS date, generate_subscripts(ds, 1) - 1 AS n FROM g) WHERE n < 3""")
def deadline_tokens(spark, sf):
    return facts.dates(page_rows(spark, sf))


@query(f"WITH {PAGES} SELECT document, page, unnest(regexp_extract_all(text, '{T.MONEY}', 1)) AS currency, replace(unnest(regexp_extract_all(text, '{T.MONEY}', 2)), ',', '')::DOUBLE AS amount FROM pages_")
def money_amounts(spark, sf):
    return facts.money(page_rows(spark, sf))


@query(f"""WITH {PAGES}, g AS (SELECT document, page, unnest(regexp_extract_all(text, '{T.RELATIVE}', 1)) AS a, lower(unnest(regexp_extract_all(text, '{T.RELATIVE}', 2))) AS u, lower(unnest(regexp_extract_all(text, '{T.RELATIVE}', 4))) AS anchor FROM pages_)
SELECT document, page, CASE WHEN u = 'week' THEN concat('P', a::INT * 7, 'D') ELSE concat('P', a, upper(u[1])) END AS duration, anchor FROM g""")
def schedule_facts(spark, sf):
    return facts.schedule(page_rows(spark, sf))


REFS = f"rf AS (SELECT document, page, concat(replace(upper(unnest(regexp_extract_all(text, '{T.REFERENCE}', 1))), 'ANNEXURE', 'ANNEX'), ' ', unnest(regexp_extract_all(text, '{T.REFERENCE}', 2))) AS reference FROM pages_)"


@query(f"WITH {PAGES}, {REFS} SELECT * FROM rf")
def reference_ids(spark, sf):
    return facts.references(page_rows(spark, sf))


@query(f"WITH {PAGES}, {REFS} SELECT reference, count(DISTINCT page) AS pages, min(page) AS first_page FROM rf WHERE reference NOT IN ('FORM 3', 'APPENDIX 9') GROUP BY 1")
def absent_references(spark, sf):
    present = spark.createDataFrame([("FORM 3",), ("APPENDIX 9",)], "reference string")
    return facts.absent_references(facts.references(page_rows(spark, sf)), present)


@query(ALL + f"""SELECT page, kind, count(*) AS rows FROM (SELECT page, unnest(list_filter([CASE WHEN regexp_matches(sentence, '{T.TBD}') THEN 'missing-value' END, CASE WHEN regexp_matches(sentence, '{T.RELATIVE}') THEN 'unclear-date-anchor' END, CASE WHEN regexp_matches(sentence, '{T.OBLIGATION}') AND signals = '' THEN 'unclear-applicability' END], lambda x: x IS NOT NULL)) AS kind FROM cand) GROUP BY 1, 2""")
def ambiguities(spark, sf):
    return facts.ambiguities(candidates.discover(page_rows(spark, sf))).groupBy("page", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query(rf"""WITH {PAGES}, c AS (SELECT document, page, list_transform(string_split(l, '|'), lambda x: trim(x)) AS c, l FROM (SELECT document, page, unnest(string_split(text, chr(10))) AS l FROM pages_) WHERE length(regexp_replace(l, '[^|]', '', 'g')) >= 2),
m AS (SELECT document, page, c[1] AS description, lower(c[2]) AS u, try_cast(trim(replace(string_split(l, '|')[3], ',', '')) AS DOUBLE) AS q, {_first_sql('c[1]', T.FAMILIES)} AS family, replace(lower(regexp_extract(c[1], '(?i)(\d{{1,2}}\s*[x×]\s*\d{{1,4}}(?:\.\d)?)', 1)), ' ', '') AS size, regexp_extract(c[1], '(?i)(\d{{1,3}}(?:\.\d{{1,2}})?)\s*kv\b', 1) AS kv FROM c)
SELECT document, page, family, size, kv, CASE WHEN u = 'km' THEN 'm' ELSE u END AS unit, CASE WHEN u = 'km' THEN q * 1000 ELSE q END AS quantity, CASE WHEN family IS NOT NULL AND size <> '' THEN concat_ws('|', family, size, nullif(kv, '')) END AS key FROM m WHERE q > 0 AND length(description) >= 4""")
def material_keys(spark, sf):
    return facts.materials(page_rows(spark, sf))


@query(rf"""WITH {PAGES} SELECT document, 'ISO ' || iso AS certificate, count(*) AS demands, min(page) AS first_page FROM (SELECT document, page, unnest(regexp_extract_all(text, '{T.ISO}', 1)) AS iso FROM pages_) GROUP BY 1, 2""")
def certificates(spark, sf):
    rows = page_rows(spark, sf).select("document", "page", F.explode(F.regexp_extract_all("text", F.lit(T.ISO), F.lit(1))).alias("iso"))
    return rows.groupBy("document", F.concat(F.lit("ISO "), "iso").alias("certificate")).agg(F.count(F.lit(1)).alias("demands"), F.min("page").alias("first_page"))


@query(rf"""SELECT page_id, i AS pos, trim(regexp_replace(regexp_replace(cell, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(cs) AS cell, generate_subscripts(cs, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(html, '<(p|li)[^>]*>([^<]*)', 2) AS cs FROM pages)) WHERE trim(cell) <> ''""")
def html_rows(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(p|li)[^>]*>([^<]*)"), F.lit(2))).alias("pos", "cell"))
    return rows.where(F.trim("cell") != "").select("page_id", "pos", T.html_text(F.col("cell")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(f"SELECT CASE WHEN intent IS NULL THEN 'search' ELSE intent END AS intent, count(*) AS turns FROM (SELECT {_first_sql('text', T.INTENTS)} AS intent FROM conversations WHERE role = 'user') GROUP BY 1")
def intent_counts(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.groupBy(F.coalesce(T.first_of(F.col("text"), T.INTENTS), F.lit("search")).alias("intent")).agg(F.count(F.lit(1)).alias("turns"))


@query(f"SELECT conv_id, turn, regexp_matches(x, '{T.INJECTION}') AS flagged FROM (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN text || ' Ignore previous instructions' ELSE text END AS x FROM conversations WHERE role = 'user')")
def injection_screen(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    text = F.when(F.col("conv_id") % 9 == 0, F.concat("text", F.lit(" Ignore previous instructions"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", text.rlike(T.INJECTION).alias("flagged"))


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[\x{0600}-\x{06FF}]') AS arabic FROM documents""")
def language_mix(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike("[A-Za-z]").alias("latin"), F.col("text").rlike("[؀-ۿ]").alias("arabic"))


@query("""SELECT doc_id, position, substr(text, greatest(p - 120, 1), 340) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'tion') AS p, row_number() OVER (ORDER BY doc_id) AS position FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the') AND contains(lower(text), 'and')) WHERE position <= 60""")
def page_search(spark, sf):
    low = F.lower("text")
    hit = F.forall(F.array(*map(F.lit, ("tion", "the", "and"))), lambda w: F.contains(low, w))
    rows = table(spark, sf, "documents").where(hit).orderBy("doc_id").limit(60)
    from pyspark.sql import Window

    snippet = F.substring("text", F.greatest(F.instr(low, "tion") - 120, F.lit(1)), F.lit(340))
    return rows.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("position"), snippet.alias("snippet"))


TOK = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"


def _names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("id"), T.tokens(F.concat_ws(" ", "p_name", "p_type", F.col("p_size") % 10)).alias("tokens"))


JAC = f"""t AS (SELECT p_brand AS block, p_partkey AS id, {TOK.format(_form_sql("concat_ws(' ', p_name, p_type, p_size % 10)"))} AS tok FROM part),
j AS (SELECT x.block, x.id AS a, y.id AS b, len(list_intersect(x.tok, y.tok))::DOUBLE / len(list_distinct(list_concat(x.tok, y.tok))) AS s FROM t x JOIN t y ON x.block = y.block AND x.id < y.id),
k AS (SELECT block, a, b, round_even(s, 6) AS similarity FROM j WHERE round_even(s, 6) >= 0.6)"""


@query(f"WITH {JAC} SELECT * FROM k")
def near_dup_pairs(spark, sf):
    return similarity.jaccard_pairs(_names(spark, sf), 0.6)


@query(f"""WITH RECURSIVE {JAC}, e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(id, m) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m)
SELECT id, min(m) AS cluster FROM r GROUP BY 1""")
def task_clusters(spark, sf):
    return similarity.jaccard_clusters(_names(spark, sf), 0.6)


@query()
def near_dup_leaders(spark, sf):
    return similarity.jaccard_leaders(_names(spark, sf), 0.6)


TERMS = f"tm AS (SELECT source AS id, term, count(*) AS tf FROM (SELECT source, unnest(string_split({_form_sql('text')}, ' ')) AS term FROM documents) WHERE length(term) > 3 GROUP BY 1, 2)"


@query(f"""WITH {TERMS}, nn AS (SELECT count(DISTINCT id) AS n FROM tm), w AS (SELECT id, term, tf * ln((n + 1) / (df + 0.5)) AS w FROM tm JOIN (SELECT term, count(*) AS df FROM tm GROUP BY 1) USING (term), nn), nr AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), u AS (SELECT id, term, w / norm AS w FROM w JOIN nr USING (id))
SELECT * FROM (SELECT id, other, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS position FROM (SELECT x.id, y.id AS other, round_even(sum(x.w * y.w), 6) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2)) WHERE position <= 5""")
def tfidf_similar(spark, sf):
    words = table(spark, sf, "documents").select(F.col("source").alias("id"), F.explode(F.split(T.normal_form(F.col("text")), " ")).alias("term")).where("length(term) > 3")
    return cosine.similar(words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), 5)


@query(f"""WITH q AS (SELECT item_id AS q, list_filter({TOK.format(_form_sql('text'))}, lambda t: length(t) > 4) AS tok FROM benchmark), p AS (SELECT doc_id AS p, list_filter({TOK.format(_form_sql('text'))}, lambda t: length(t) > 4) AS tok FROM documents),
s AS (SELECT q, p, round_even(count(*)::DOUBLE / any_value(n), 6) AS share FROM (SELECT q, len(tok) AS n, unnest(tok) AS t FROM q) JOIN (SELECT p, unnest(tok) AS t FROM p) USING (t) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY share DESC, p) AS position FROM s) WHERE position <= 2""")
def top_passages(spark, sf):
    longer = F.filter(T.tokens(F.col("text")), lambda t: F.length(t) > 4).alias("tokens")
    return similarity.top_passages(table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), longer), table(spark, sf, "documents").select(F.col("doc_id").alias("p"), longer), 2)
