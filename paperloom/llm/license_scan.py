"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright clauses out, equivalent spellings replaced,
punctuation and white space made single spaces. The SHA-256 of that form is hash-joined to the digests of
known licence texts. The same is done for each line, as documents carry one-line licence notices. The bodies
of the licences in the folder licenses are looked for inside longer documents too, however they are wrapped.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table

#: Equivalent spellings, replaced after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("noncommercial", "non-commercial"), ("https", "http"),
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgment", "judgement"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organis", "organiz"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"),
)
COPYRIGHT = r"(?m)^[^\n]*(copyright \(c\)|copyright ©|©|\(c\) [0-9]{4}|copyright [0-9]{4}|all rights reserved)[^\n]*$"

#: A copyright clause runs from its mark to the end of the sentence or line, or to words with which a licence opens.
#: What else stands on the line is kept; where no end is in reach, nothing is cut.
OPENS = r"(?:permission (?:is|to) |redistribution and |licensed under |released under |(?:this (?:software|work|program|file) (?:is|may) )|everyone is permitted)"
CLAUSE = rf"(?m)(?:copyright[ \t]*(?:\(c\)|©|(?=[0-9]{{4}}))|©|\(c\)(?= [0-9]{{4}}))(?:(?!\b{OPENS})(?:[^\n.]|\.(?!\s|$)|\.(?= +(?:and |<|\()))){{0,400}}+(?:\.|$|(?=\b{OPENS}))|all rights reserved\.?"

#: Short public licence texts and notices, as (licence, text).
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

#: Where the body of a licence begins, after title and copyright, and ends, before instructions for its use.
BEGIN = re.compile(r"(?m)^[ \t]*(?:Permission (?:to|is) |Redistribution and |This software is provided|Everyone is permitted|TERMS AND CONDITIONS FOR USE|1\. Definitions|Statement of Purpose|This is free and unencumbered|Preamble)")
END = re.compile(r"(?mi)^[ \t]*(?:END OF TERMS AND CONDITIONS|EXHIBIT A\b|ADDENDUM: How to)")
#: A known text of so many words is looked for inside documents; shorter ones are common speech unless a line of their own.
BLOCK_WORDS = 15


@cache
def texts() -> tuple[tuple[str, str, str], ...]:
    """(licence, whole text, body) of the files in the folder licenses, with and without title and appendix, numbers or bullets."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        full = path.read_text(encoding="utf-8")
        forms = [full]
        if path.stem.startswith("BSD"):
            for items in (r"\*", r"[0-9]\."):
                if re.search(rf"(?m)^ *{items} ", full):
                    number = iter("123")
                    forms.append(re.sub(rf"(?m)^ *{items} ", lambda m: f"{next(number)}. " if items == r"\*" else "* ", full))  # noqa: B023
        for text in forms:
            begin, end = BEGIN.search(text).start(), END.search(text)
            ends = {len(text), end.start(), end.end()} if end else {len(text)}
            body = text[begin : end.start() if end else len(text)]
            out += [(path.stem, text[a:b], body) for a in (0, begin) for b in sorted(ends)]
    return tuple(out)


def canonical(text: F.Column) -> F.Column:
    """The canonical form of a text, its lines kept."""
    out = F.regexp_replace(F.lower(text), CLAUSE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(out, r" *\n[ \n]*", "\n")


def _flat(form: F.Column) -> F.Column:
    """A canonical form on one line; spellings of two words may have been parted by a line's end."""
    out = F.trim(F.regexp_replace(form, r"\s+", " "))
    return F.replace(F.replace(out, F.lit("copyright holder"), F.lit("copyright owner")), F.lit("sub license"), F.lit("sublicense"))


def _digest(form: F.Column) -> F.Column:
    return F.sha2(_flat(form), 256)


def registry(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, whole: tuple[tuple[str, str, str], ...] | None = None) -> DataFrame:
    """(license, digest, block) of known notices and whole texts; block is what is looked for inside documents, or null."""
    rows = [(a, t, t if len(t.split()) >= BLOCK_WORDS else None) for a, t in known] + list(texts() if whole is None else whole)
    rows = spark.createDataFrame(rows, "license string, text string, body string")
    return rows.select("license", _digest(canonical(F.col("text"))).alias("digest"), _flat(canonical(F.col("body"))).alias("block")).distinct()


def _blocks(flat: F.Column, known: DataFrame) -> F.Column:
    """The licences whose blocks stand in a flat text. The longest are taken out first, so that one in another does not count."""
    bodies = sorted({(r["license"], r["block"]) for r in known.select("license", "block").where("block is not null").collect()}, key=lambda x: (-len(x[1]), x))
    none = F.array().cast("array<string>")
    if not bodies:
        return none
    blocks = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(f" {t} ").alias("block")) for a, t in bodies])
    start = F.struct(F.concat(F.lit(" "), flat, F.lit(" ")).alias("rest"), none.alias("found"))

    def take(state: F.Column, b: F.Column) -> F.Column:
        taken = F.struct(F.replace(state["rest"], b["block"], F.lit(" \n ")).alias("rest"), F.concat(state["found"], F.array(b["license"])).alias("found"))
        return F.when(F.contains(state["rest"], b["block"]), taken).otherwise(state)

    return F.array_distinct(F.aggregate(blocks, start, take)["found"])


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, canonical_sha256, license (of the whole text, or null), notices.

    notices holds the licences of single lines and of licence blocks in the text, sorted and comma-joined, empty if
    none. A null text counts as empty, which no licence is. Null doc_ids and repeated rows are kept. The text is read
    once and not shuffled; the digests are joined as plain columns, and Spark broadcasts known only if it is small.
    The blocks of known go to the executors with the plan.
    """
    form = canonical(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", form.alias("form"))
    lines = F.array_distinct(F.transform(F.filter(F.split("form", "\n"), lambda x: F.trim(x) != ""), _digest))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", _digest(F.col("form")).alias("canonical_sha256"), lines.alias("lines"), _blocks(_flat(F.col("form")), known).alias("blocks"))
    rows = shared_table(rows, "digests")
    digests = known.select("license", "digest").distinct()
    found = rows.select("row", F.explode("lines").alias("digest")).join(digests, "digest").select("row", "license")
    found = found.union(rows.select("row", F.explode("blocks").alias("license")))
    found = found.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = digests.groupBy(F.col("digest").alias("canonical_sha256")).agg(F.min("license").alias("license"))
    out = rows.select("row", "doc_id", "canonical_sha256").join(whole, "canonical_sha256", "left").join(found, "row", "left")
    return out.select("doc_id", "canonical_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), registry(spark))


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g')"


def _sql_digest(form: str) -> str:
    return rf"sha256(trim(regexp_replace({form}, '\s+', ' ', 'g')))"


def _oracle() -> str:
    known = ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license, {_sql_digest(_sql_form("text"))} AS digest FROM (VALUES {known}) v(license, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_form("coalesce(text, '')")} AS form FROM documents),
l AS (SELECT DISTINCT r, {_sql_digest("line")} AS digest FROM (SELECT r, unnest(string_split(form, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k USING (digest) GROUP BY r)
SELECT doc_id, {_sql_digest("form")} AS canonical_sha256, (SELECT min(license) FROM k WHERE k.digest = {_sql_digest("d.form")}) AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN n USING (r)
"""


SQL = {"op2_license_scan": _oracle()}
QUERIES = {"op2_license_scan": op2_license_scan}
