"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: any of several sets, all of
whose trigrams a text must hold. The index keeps, for each document, the trigrams that some rule asks for.
Intersecting the postings of each set gives a rule's candidates, whose texts alone are matched with the
expression. A rule from which no trigram can be derived is matched with every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, dropped if the group is shorter than least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values. Of a run that a rule would drop for its length no part can match, so hex and access say the length in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: An exact set of strings is followed no further than this.
MOST = 32


def _exact(item, most: int) -> set[str] | None:
    """All strings that a parsed item matches, in lower case; None if there are too many."""
    kind, value = item
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is sre.LITERAL:
                chars.add(chr(v).lower())
            elif k is sre.RANGE and v[1] - v[0] < most:
                chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return chars if len(chars) <= most else None
    if kind is sre.SUBPATTERN:
        return _exact_all(value[3], most)
    if kind is sre.BRANCH:
        parts = [_exact_all(p, most) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is sre.MAX_REPEAT and value[:2] == (0, 1):
        once = _exact_all(value[2], most)
        return None if once is None else once | {""}
    return None


def _exact_all(items, most: int) -> set[str] | None:
    out = {""}
    for item in items:
        more = _exact(item, most)
        if more is None or len(out) * len(more) > most:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams (of the text in lower case), all of one of which any match must hold; empty: no such sets."""
    asked: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            asked.append([s for s in sets if not any(t < s for t in sets)])

    run = {""}
    for item in sre_parse.parse(pattern):
        more = _exact(item, MOST)
        if more is not None and len(run) * len(more) <= MOST:
            run = {a + b for a, b in product(run, more)}
        else:
            flush(run)
            run = more if more is not None else {""}
    flush(run)
    return sorted({frozenset().union(*p) for p in product(*asked)}, key=sorted) if asked else []


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) of the given trigrams that the lower-case text of each row holds."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document meets, as bits by their place in rules."""
    spark = index.sparkSession
    rows = [(at, i, t, len(s)) for at, r in enumerate(rules) for i, s in enumerate(trigram_query(r.pattern)) for t in sorted(s)]
    asked = spark.createDataFrame(rows, "rule int, nth int, trigram string, size int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "nth").agg(F.size(F.collect_set("trigram")).alias("n"), F.max("size").alias("size"))
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(rules))]), F.col("rule") + 1).cast("long")
    return met.where("n = size").select("doc_id", bit.alias("bit")).groupBy("doc_id").agg(F.bit_or("bit").alias("kinds"))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def running_sums(xs: Column, width: int = 128) -> Column:
    """Sums of an array up to and including each element; blocks of width keep the work near the length of the array."""
    zero = F.lit(0).cast("bigint")
    add = lambda a, x: a + x

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
        before = _let(totals, lambda t: F.transform(t, lambda _, i: F.aggregate(F.slice(t, 1, i), zero, add)))
        return F.flatten(F.zip_with(blocks, before, lambda b, base: F.transform(b, lambda _, i: base + F.aggregate(F.slice(b, 1, i + 1), zero, add))))

    def of(v: Column) -> Column:
        heads = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))
        return _let(F.transform(heads, lambda b: F.slice(v, b * width + 1, width)), of_blocks)

    return _let(xs, of)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of a rule's matches, found by adding up the lengths between and in them."""
    matched = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), group), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    reach = _let(matched(0), lambda m: F.zip_with(running_sums(F.zip_with(gaps, m, lambda g, w: (g + F.coalesce(w, F.lit(0))).cast("bigint"))), m, lambda end, w: F.struct((end - w).alias("start"), end.alias("end"))))
    held = F.filter(F.zip_with(reach, matched(rule.group), lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] >= rule.least)
    return F.transform(held, lambda x: x["s"]).cast("array<struct<start:bigint,end:bigint>>")


#: So many candidates at most are broadcast, of some 50 bytes each; more are shuffled, with the texts.
MOST_SENT = 500_000


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of docs: doc_id, an array column of (start, end) for each rule's kind.

    A null text counts as empty. Rows that share a doc_id, null included, share their candidacy and are
    matched each on its own. No rows give no rows; other columns of docs are not read. The candidates are
    counted: where they are few the texts stay where they lie, else texts and candidates are shuffled by doc_id.
    """
    asked = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for sets in asked for s in sets for t in s})
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    index = shared_table(postings(plain, trigrams), "postings")
    wanted = shared_table(candidates(index, rules).select(F.col("doc_id").alias("__id"), "kinds"), "wanted")
    few = wanted.count() <= most_sent
    rows = plain.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    columns = []
    for i, r in enumerate(rules):
        try_it = F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0 if asked[i] else F.rlike("text", F.lit(r.pattern))
        columns.append(F.when(try_it, spans(F.col("text"), r)).otherwise(none).alias(r.kind))
    return rows.select("doc_id", *columns)


def _joined(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of all spans of rules, by start, then by the order of the rules."""

    def tagged(i: int, rule: Rule) -> Column:
        return F.transform(rule.kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end")))

    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(F.concat(*[tagged(i, r) for i, r in enumerate(rules)])), lambda s: F.concat_ws(":", F.element_at(kinds, s["i"] + 1), s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = tuple(r for r in RULES if r.base)
    return found.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(RULES).alias("spans"))


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {i} AS i, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
       list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(alls[1:n - 1], lambda x: length(x))), 0) AS s, length(alls[n]) AS l
FROM (SELECT *, unnest(range(1, len(alls) + 1)) AS n FROM (SELECT r, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS alls, regexp_extract_all(t, '{p}', {r.group}) AS got FROM d))
WHERE length(got[n]) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts},
             string_agg(concat(kind, ':', s::BIGINT, ':', (s + l)::BIGINT), ',' ORDER BY s, i) FILTER (base) AS b,
             string_agg(concat(kind, ':', s::BIGINT, ':', (s + l)::BIGINT), ',' ORDER BY s, i) AS a FROM m GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SQL = {"op10_secret_scan": _oracle()}
QUERIES = {"op10_secret_scan": op10_secret_scan}
