"""Queries on the evidence of requirements and on samples of packages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import bills as B
from paperloom.operators import cosine, sampling
from paperloom.operators import headings as H
from paperloom.operators import owners as O
from paperloom.plans.texts import PAGES, page_rows
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


STOP = "('" + "', '".join(T.STOP_WORDS) + "')"
WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN " + STOP + ")"


# a requirement is a benchmark passage; every line of a document is a fact, the first line of some names a requirement
@query(f"""WITH ev AS (SELECT doc_id * 100000 + line AS id, text, CASE WHEN line = 0 AND doc_id % 3 = 0 THEN doc_id % 60 END AS supports, ['PASS', 'REVIEW', 'FAIL'][(doc_id % 4 % 3 + 1)::INT] AS status
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)),
al AS (SELECT 'r' AS side, item_id AS id, {WORDS} AS words FROM benchmark UNION ALL SELECT 'e', id, {WORDS} FROM ev),
tf AS (SELECT side, id, w, count(*) AS tf FROM (SELECT side, id, unnest(words) AS w FROM al) GROUP BY ALL),
df AS (SELECT w, ln((1 + (SELECT count(*) FROM al)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY w),
v AS (SELECT side, id, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY side, id)) AS x FROM tf JOIN df USING (w)),
c AS (SELECT r.id AS id, e.id AS ev, round_even(sum(r.x * e.x), 6) AS cosine FROM v r JOIN v e ON r.w = e.w AND r.side = 'r' AND e.side = 'e' GROUP BY 1, 2),
own AS (SELECT supports AS id, max(id) AS ev, max_by(status, id) AS status FROM ev WHERE supports IS NOT NULL GROUP BY 1),
near AS (SELECT id, max(cosine) AS cosine, (min({{'c': -cosine, 'ev': ev}})).ev AS ev FROM c WHERE cosine > 0.5 GROUP BY 1)
SELECT b.item_id AS id, CASE WHEN own.ev IS NOT NULL AND coalesce(c.cosine, 0) >= 0.3 THEN own.status ELSE 'MISSING_EVIDENCE' END AS status, own.ev::VARCHAR AS evidence,
  CASE WHEN own.ev IS NOT NULL THEN coalesce(c.cosine, 0) ELSE coalesce(near.cosine, 0) END AS score, CASE WHEN own.ev IS NULL THEN near.ev::VARCHAR END AS candidate
FROM benchmark b LEFT JOIN own ON own.id = b.item_id LEFT JOIN c ON c.id = b.item_id AND c.ev = own.ev LEFT JOIN near ON near.id = b.item_id""")
def best_evidence(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    status = F.element_at(F.array(*map(F.lit, ("PASS", "REVIEW", "FAIL"))), (F.col("doc_id") % 4 % 3 + 1).cast("int"))
    supports = F.when((F.col("line") == 0) & (F.col("doc_id") % 3 == 0), F.col("doc_id") % 60)
    facts = lines.select((F.col("doc_id") * 100000 + F.col("line")).alias("id"), "text", supports.alias("supports"), status.alias("status"))
    return cosine.best_evidence(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), facts).withColumns({c: F.col(c).cast("string") for c in ("evidence", "candidate")})


# ---- references: pages open with one of these by doc_id, and close with the clause that page_rows gives them

HEADS = (
    "APPENDIX 7\nTechnical Schedules\n", "ANNEX A General\nANNEX B-2\nNOT APPLICABLE\nANNEX D Drawings\n", "All works in accordance with\nFORM 3 of the bid\n", "a | b | c | d\nAPPENDIX VIII TO MAIN SCOPE\n",
    "ANNEXURE\nC\nTemplate Administration\n", "Exhibit Q-1, as signed, and a form V. See form 4, Form 11 and\nAPPENDIX - IX\n", "", "FORM 2A.\n",
)


def _sql_text(held: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + h.replace("'", "''") + "'" for h in held) + "]"


_plain = "replace(replace(replace(replace({}, '\u0002', ' '), '\u0001', ''), '\u0003', ''), '\u0004', '')".format
_token, _strip = H.TOKEN, r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
_key = lambda w, i: f"concat(regexp_replace(upper({w}), '^ANNEXURE$', 'ANNEX'), ' ', {i})"
_mark = (r"regexp_replace(regexp_replace(regexp_replace({}, '" + H.BROKEN.replace("{", "{{").replace("}", "}}") + "', '\u0001\\1\u0002\\2\u0003\u0004\\3', 'g'), '" + H.WHOLE.replace("{", "{{").replace("}", "}}") + "', '\u0001\\1\u0002\\2\u0003\\3', 'g'), '\u0001(form|exhibit)\u0002([^\u0003]*)\u0003\u0004?', '\\1 \\2', 'g')").format
_stop = lambda words: "('" + "', '".join(words) + "')"
REFERENCES = PAGES.replace("AS text FROM documents", "AS text, doc_id FROM documents") + f""",
mk AS (SELECT document, page, {_mark("coalesce(" + _sql_text(HEADS) + "[(doc_id % 8 + 1)::INT] || text, '')")} AS m FROM pages_),
mt AS (SELECT document, page, unnest(list_transform(regexp_extract_all(m, '{_token}'), lambda t: {_key(f"regexp_extract(t, '{_token}', 1)", f"regexp_extract(t, '{_token}', 2)")})) AS reference, generate_subscripts(regexp_extract_all(m, '{_token}'), 1) - 1 AS place FROM mk),
un AS (SELECT document, page, list_filter(list_transform(regexp_split_to_array(m, '[\n|]'), lambda u: {_strip("u")}), lambda u: u <> '') AS units FROM mk),
ld AS (SELECT *, coalesce(list_sum(list_transform(units[1:i - 1], lambda u: 1 + length(u) - length(replace(u, '\u0004', '')))), 0) AS n_before, {_plain("coalesce(units[i - 1], '')")} AS above, coalesce(units[i + 1], '') AS u1, coalesce(units[i + 2], '') AS u2,
  {_key(f"regexp_extract(units[i], '^{_token}', 1)", f"regexp_extract(units[i], '^{_token}', 2)")} AS reference, {_plain(_strip(f"regexp_replace(units[i], '^{_token}' || '\u0004?', '')"))} AS rest
  FROM (SELECT *, unnest(range(1, len(units) + 1)) AS i FROM un) WHERE starts_with(units[i], '\u0001')),
tl AS (SELECT *, CASE WHEN starts_with(rest, '.') THEN {_strip("substr(rest, 2)")} ELSE rest END AS tail, {_plain("u1")} AS below, {_plain("u2")} AS second,
  list_filter([rest, CASE WHEN starts_with(u1, '\u0001') THEN '' ELSE {_plain("u1")} END, CASE WHEN starts_with(u1, '\u0001') OR starts_with(u2, '\u0001') THEN '' ELSE {_plain("u2")} END], lambda x: x <> '') AS entry FROM ld),
mn AS (SELECT *, CASE WHEN tail = '' THEN below ELSE tail END AS main, regexp_replace(tail, '^(?:{H.DASH}|[:. \t])+', '') AS bare FROM tl),
tg AS (SELECT *, lower(regexp_extract(coalesce(CASE WHEN main = 'TO' THEN CASE WHEN tail = '' THEN second ELSE below END WHEN starts_with(main, 'TO ') THEN substr(main, 4) END, ''), '^\\s*(\\S+)', 1)) AS target FROM mn),
hd AS (SELECT document, page, reference, n_before, coalesce(lower(regexp_extract_all(above, '[A-Za-z&]+')[-1]) NOT IN {_stop(H.RUNS_ON)}, true) AND NOT (regexp_matches(rest, '^[,;]') OR rest IN ('.', ')'))
  AND CASE WHEN tail = '' THEN NOT regexp_matches(below, '^\\p{{Ll}}') ELSE regexp_matches(bare, '^[\\p{{Lu}}\\p{{Nd}}(]') AND NOT list_has_any(regexp_extract_all(bare, '[a-z]+'), {_stop(H.STOP).replace("(", "[").replace(")", "]")}) END
  AND (n_before < 3 OR target <> '' AND target NOT IN {_stop(H.STOP)}) AS own,
  regexp_matches(coalesce(entry[1], ''), '{H.NOT_APPLICABLE}') OR len(list_filter(entry[1:2], lambda u: regexp_matches(u, '{H.ONLY_NOT_APPLICABLE}'))) > 0 AS absent FROM tg),
ls AS (SELECT document, page, count(DISTINCT reference) >= 3 OR count(DISTINCT reference) FILTER (n_before < 15) >= 2 AS listing FROM hd GROUP BY 1, 2),
oh AS (SELECT document, page, reference, NOT listing AND own AS own_heading, listing AND absent AS not_applicable FROM hd JOIN ls USING (document, page))"""


def referring_pages(spark, sf):
    pages = page_rows(spark, sf)
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page") % 8 + 1).cast("int"))
    return pages.withColumn("text", F.concat(head, "text"))


@query(f"WITH {REFERENCES} SELECT * FROM oh")
def own_headings(spark, sf):
    return H.headings(referring_pages(spark, sf))


# files of the package are named after some forms
@query(f"""WITH {REFERENCES}, fl AS (SELECT unnest(regexp_extract_all({_mark("upper(replace('bid_form_' || n_nationkey || '.pdf', '_', ' '))")}, '{_token}')) AS t FROM nation WHERE n_nationkey % 8 = 3),
pr AS (SELECT {_key(f"regexp_extract(t, '{_token}', 1)", f"regexp_extract(t, '{_token}', 2)")} AS reference FROM fl UNION SELECT reference FROM oh WHERE own_heading OR not_applicable),
ms AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY document, page, place) AS nth FROM mt WHERE reference NOT IN (SELECT reference FROM pr))
SELECT reference, count(*) AS mentions, string_agg(concat(document, '#p', page), ', ' ORDER BY nth) FILTER (nth <= 3) AS evidence FROM ms GROUP BY 1""")
def absent_documents(spark, sf):
    files = table(spark, sf, "nation").where("n_nationkey % 8 = 3").select(F.concat(F.lit("bid_form_"), "n_nationkey", F.lit(".pdf")).alias("filename"))
    return H.absent_documents(referring_pages(spark, sf), files)


# ---- samples


@query()
def representative_chunks(spark, sf):
    """Fifty documents are a tender, seven of them a document of it. Greedy choice has no plain SQL; a test holds it against a plain one."""
    rows = page_rows(spark, sf).select((F.col("page") / 50).cast("long").alias("tender"), (F.col("page") / 7).cast("long").alias("document"), F.col("page").alias("position"), "page", "text")
    return sampling.representative_chunks(rows)


# ---- bills in sheets of any layout: an order is a sheet, with one of these beginnings by its key

SHEET_HEADS = (
    (("No.", "Description", "UOM", "Qty", "Unit Price (SAR)", "Total Price"),),
    (("Bill of quantities", "", "", "", "", ""), ("Sheet 2", "", "", "", "", ""), ("البند", "الوصف", "الوحدة", "الكمية", "سعر الوحدة", "الاجمالى")),
    (),
    (("S.No", "Works particulars", "Remarks", "Quantity in all", "Material unit price", "Amount"),),
)
_heads = "[" + ", ".join("[" + ", ".join("['" + "', '".join(row) + "']" for row in rows) + "]" + ("::VARCHAR[][]" if not rows else "") for rows in SHEET_HEADS) + "]"
_quoted = lambda words: "('" + "', '".join(words) + "')"
_slot = "CASE " + " ".join("WHEN n IN " + _quoted(a) + "".join(f" OR contains(n, '{x}')" for x in a if " " in x) + f" THEN '{s}'" for s, a in B.ALIASES.items())
_slot += " " + " ".join("WHEN " + " OR ".join(f"starts_with(n, '{x} ') OR ends_with(n, ' {x}')" for x in a if " " not in x) + f" THEN '{s}'" for s, a in B.ALIASES.items()) + " END"
_last = lambda s: f"trim(coalesce(arg_max(cell, col) FILTER (key = '{s}'), ''))"


@query(f"""WITH ln AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth, [l_linenumber::VARCHAR, CASE WHEN l_partkey % 5 = 0 THEN 'pos' WHEN l_partkey % 3 = 0 THEN p_name || ' كابل نحاس' ELSE p_name END, CASE WHEN l_partkey % 4 = 0 THEN 'see drawing number ' || l_suppkey ELSE 'pcs' END, l_quantity::INT::VARCHAR, l_suppkey::VARCHAR, ''] AS cells FROM lineitem JOIN part ON p_partkey = l_partkey),
rw AS (SELECT l_orderkey AS sheet, nth + len({_heads}[(l_orderkey % 4 + 1)::INT]) AS row, cells FROM ln UNION ALL SELECT l_orderkey, unnest(range(1, len({_heads}[(l_orderkey % 4 + 1)::INT]) + 1)), unnest({_heads}[(l_orderkey % 4 + 1)::INT]) FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
ce AS (SELECT sheet, row, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col FROM rw),
sl AS (SELECT *, {_slot} AS slot FROM (SELECT *, trim(regexp_replace(lower(cell), '\\s+', ' ', 'g')) AS n FROM ce WHERE row <= {B.HEADER_ROWS})),
hr AS (SELECT sheet, min(row) AS head FROM (SELECT sheet, row FROM sl GROUP BY 1, 2 HAVING count(DISTINCT slot) >= 2 AND bool_or(slot = 'description')) GROUP BY 1),
ky AS (SELECT sheet, col, coalesce(slot, chr(1) || cell) AS key FROM sl JOIN hr USING (sheet) WHERE row = head),
kc AS (SELECT ce.*, key, key IS NULL OR col = max(col) OVER (PARTITION BY sheet, row, key) AS alive FROM ce JOIN hr USING (sheet) LEFT JOIN ky USING (sheet, col) WHERE row > head),
it AS (SELECT sheet, row, {", ".join(f"{_last(s)} AS {s}" for s in B.ALIASES)}, arg_max(trim(cell), (length(trim(cell)), -col)) FILTER (alive AND length(trim(cell)) >= {B.LONG}) AS long FROM kc GROUP BY 1, 2),
ds AS (SELECT * REPLACE (CASE WHEN length(description) < {B.SHORT} THEN coalesce(long, description) ELSE description END AS description) FROM it)
SELECT concat('order ', sheet % 7) AS document, concat('S', sheet, '!R', row) AS location, nullif(item, '') AS item, description, nullif(trim(regexp_replace(regexp_replace(description, '{B.ARABIC}', ' ', 'g'), '\\s+', ' ', 'g')), '') AS description_en, nullif(array_to_string(regexp_extract_all(description, '{B.ARABIC}'), ' '), '') AS description_ar, nullif(unit, '') AS unit, nullif(quantity, '') AS quantity, nullif(unit_price, '') AS unit_price, nullif(total_price, '') AS total_price FROM ds WHERE length(description) >= {B.LEAST}""")
def bill_items(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    part = F.col("l_partkey")
    name = F.when(part % 5 == 0, "pos").when(part % 3 == 0, F.concat("p_name", F.lit(" كابل نحاس"))).otherwise(F.col("p_name"))
    unit = F.when(part % 4 == 0, F.concat(F.lit("see drawing number "), "l_suppkey")).otherwise("pcs")
    cells = F.array(F.col("l_linenumber").cast("string"), name, unit, F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string"), F.lit(""))
    above = [F.array(*[F.struct(F.lit(i + 1).alias("row"), F.array(*map(F.lit, row)).alias("cells")) for i, row in enumerate(rows)]) if rows else F.array().cast("array<struct<row:int,cells:array<string>>>") for rows in SHEET_HEADS]
    above = F.get(F.array(*above), (F.col("l_orderkey") % 4).cast("int"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    body = lines.select(F.col("l_orderkey").alias("sheet"), nth.alias("nth"), above.alias("above"), cells.alias("cells"))
    own = F.array(F.struct((F.col("nth") + F.size("above")).alias("row"), "cells"))
    rows = body.select("sheet", F.inline(F.when(F.col("nth") == 1, F.concat("above", own)).otherwise(own)))
    return B.line_items(rows.select(F.concat(F.lit("order "), F.col("sheet") % 7).alias("document"), F.concat(F.lit("S"), "sheet").alias("sheet"), "row", "cells"))


# ---- countries and clients: twenty documents are a tender, each opens with one of these by its id

MENTIONS = (
    "Supply to the Kingdom of Saudi Arabia. ", "Tender of Egyptian Electricity Transmission, Cairo. ", "A roman road; Abu Dhabi and DEWA. ", "", "Owner: The Water Board. ", "في السعودية ومصر، قطر ",
    "Ma'aden and KAHRAMAA, Doha. ", "", "NEOM, neom and Aramco. ", "Muscat, Oman. Issued by SEC ", "",
)
_mentions = _sql_text(MENTIONS)
_named = " UNION ALL ".join(f"SELECT '{k.replace(chr(39), chr(39) * 2)}' AS gram, {len(O.parts_of(k))} AS len, '{c}' AS country, {i} AS listed" for i, (c, keys) in enumerate(O.COUNTRIES.items()) for k in keys)
_counts = " UNION ALL ".join(f"SELECT tender, place, document, page, '{c.replace(chr(39), chr(39) * 2)}' AS client, {i} AS listed, " + " + ".join(f"(length(low) - length(replace(low, '{k.replace(chr(39), chr(39) * 2)}', ''))) // {len(k)}" for k in keys) + " AS n FROM lw" for i, (c, keys) in enumerate(O.CLIENTS.items()))
OWNED = f"ow AS (SELECT doc_id // 20 // 2 * 2 + (doc_id % 3 = 0)::INT AS tender, doc_id AS place, CASE WHEN doc_id % 20 = 0 THEN 5 ELSE 1 END AS weight, source AS document, doc_id AS page, {_mentions}[(doc_id % 11 + 1)::INT] || text AS text FROM documents WHERE doc_id IS NOT NULL)"


def owned_pages(spark, sf):
    mention = F.element_at(F.array(*map(F.lit, MENTIONS)), (F.col("doc_id") % 11 + 1).cast("int"))
    tender = F.floor(F.col("doc_id") / 20)
    tender = tender - tender % 2 + (F.col("doc_id") % 3 == 0).cast("int")
    weight = F.when(F.col("doc_id") % 20 == 0, 5).otherwise(1)
    return table(spark, sf, "documents").select(tender.alias("tender"), F.col("doc_id").alias("place"), weight.alias("weight"), F.col("source").alias("document"), F.col("doc_id").alias("page"), F.concat(mention, "text").alias("text"))


@query(f"""WITH {OWNED}, nm AS ({_named}), pt AS (SELECT tender, place, weight, regexp_extract_all(lower(coalesce(text, '')), '{O.PART}') AS parts FROM ow),
wd AS (SELECT tender, place, weight, parts, unnest(range(1, len(parts) + 1)) AS i FROM pt),
ft AS (SELECT wd.*, nm.* FROM wd JOIN nm ON parts[i] = regexp_extract(gram, '{O.PART}')),
ct AS (SELECT tender, country, listed, sum(weight)::BIGINT AS mentions, min(place) AS first FROM ft WHERE array_to_string(parts[i:i + len - 1], '') = gram GROUP BY 1, 2, 3)
SELECT tender, country, mentions FROM (SELECT *, row_number() OVER (PARTITION BY tender ORDER BY mentions DESC, first, listed) AS nth FROM ct) WHERE nth = 1""")
def tender_countries(spark, sf):
    return O.countries(owned_pages(spark, sf))


@query(f"""WITH {OWNED}, lw AS (SELECT *, concat(' ', lower(coalesce(text, '')), ' ') AS low FROM ow),
cl AS (SELECT tender, client, listed, sum(n)::BIGINT AS mentions, min(place) AS first, (min({{'p': place, 'd': document, 'g': page}})).d AS document, (min({{'p': place, 'd': document, 'g': page}})).g AS page FROM ({_counts}) WHERE n > 0 GROUP BY 1, 2, 3),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tender ORDER BY mentions DESC, first, listed) AS nth FROM cl) WHERE nth = 1),
lb AS (SELECT tender, min({{'p': place, 'c': regexp_replace(regexp_extract(text, '{O.CLIENT_LINE.replace("'", "''")}', 1), '^[ .,-]+|[ .,-]+$', '', 'g'), 'd': document, 'g': page}}) AS f FROM ow WHERE regexp_matches(text, '{O.CLIENT_LINE.replace("'", "''")}') AND tender NOT IN (SELECT tender FROM bs) GROUP BY 1)
SELECT tender, client, mentions, document, page FROM bs UNION ALL SELECT tender, f.c, 0, f.d, f.g FROM lb""")
def tender_clients(spark, sf):
    return O.clients(owned_pages(spark, sf)).withColumn("mentions", F.coalesce("mentions", F.lit(0)))
