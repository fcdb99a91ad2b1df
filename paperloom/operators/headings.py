"""References to forms, exhibits, annexes and appendices: mentions, headings of their own, and those a package lacks.

A page's text is marked once: each reference becomes a token of its word and identifier, so that what follows can work on
the page's units, its lines and table cells, as one array. All of it is column expressions on the page's row, without a shuffle;
only what pages say is then brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a reference is made of. The word is read in either case, the identifier as it stands.
ONES_ROMAN, TENS_ROMAN, HUNDREDS_ROMAN = "(?:IX|IV|VI{0,3}|I{1,3})", "(?:XC|XL|LX{0,3}|X{1,3})", "(?:CM|CD|DC{0,3}|C{1,3})"
ROMAN = f"(?:M{{1,3}}{HUNDREDS_ROMAN}?{TENS_ROMAN}?{ONES_ROMAN}?|(?:CM|CD|C{{1,3}}){TENS_ROMAN}?{ONES_ROMAN}?|{TENS_ROMAN}{ONES_ROMAN}?|{ONES_ROMAN})"
IDENTIFIER = ROMAN + r"(?:[.\-]\d{1,3})*|\d{1,5}(?:[.\-]\d{1,3})*[A-Z]?|[A-Z](?:\d{1,3})?(?:[.\-]\d{1,3})*"
WORDS = "(?i:FORM|EXHIBIT|ANNEXURE|ANNEX|APPENDIX)"
DASH = "[\\-‐‑‒–—―−]"
BREAKS = r"[ \t]*(?:\n[ \t]*){1,2}"
# Words that a heading does not have in small letters; words a line runs on with.
STOP = ("the", "and", "for", "of", "to", "in", "with", "as", "shall", "be", "is", "are", "per", "see", "refer", "this", "that", "which", "will", "by", "or", "on", "at", "from", "under", "a", "an")
RUNS_ON = (*STOP, "specified", "including", "following", "&")
# Units above a heading, references that make a list page, and those in its first units.
TOP_UNITS, LIST_REFS, LIST_TOP_REFS, LIST_TOP_UNITS = 3, 3, 2, 15
NOT_APPLICABLE = r"(?i)\bNOT\s+APPLICABLE\b|\(\s*N/A\s*\)"
ONLY_NOT_APPLICABLE = "(?i)^[\\s(\\-‐‑‒–—―−]*(?:NOT\\s+APPLICABLE|N/A)[\\s)]*$"

#: A reference over a line break, and one within a line; the character behind is kept. No identifier runs into letters, digits or a plus.
BROKEN = rf"\b({WORDS})(?:{BREAKS}(?:{DASH}[ \t]*(?:\n[ \t]*){{0,2}})?|[ \t]*{DASH}{BREAKS})({IDENTIFIER})([^A-Za-z0-9+]|$)"
WHOLE = rf"\b({WORDS})(?:[ \t]+|[ \t]*{DASH}[ \t]*)({IDENTIFIER})([^A-Za-z0-9+]|$)"
TOKEN = "\u0001([^\u0002]*)\u0002([^\u0003]*)\u0003"


def marked(text: Column) -> Column:
    """text with each reference as \\u0001 word \\u0002 identifier \\u0003, and \\u0004 behind one that goes over a line break; prose words (`a form V`) stay."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\u0003\u0004", "")
    broken = F.regexp_replace(plain, BROKEN, "\u0001$1\u0002$2\u0003\u0004$3")
    whole = F.regexp_replace(broken, WHOLE, "\u0001$1\u0002$2\u0003$3")
    return F.regexp_replace(whole, "\u0001(form|exhibit)\u0002([^\u0003]*)\u0003\u0004?", "$1 $2")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _plain(unit: Column) -> Column:
    return F.translate(unit, "\u0002\u0001\u0003\u0004", " ")


def key(word: Column, identifier: Column) -> Column:
    """ANNEXURE is ANNEX."""
    return F.concat(F.regexp_replace(F.upper(word), "^ANNEXURE$", "ANNEX"), F.lit(" "), identifier)


def mentions(pages: DataFrame) -> DataFrame:
    """document, page, place, reference: every reference of pages (document, page, text), place being its number on the page."""
    found = F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(TOKEN), 0), lambda t: key(F.regexp_extract(t, TOKEN, 1), F.regexp_extract(t, TOKEN, 2)))
    return pages.select("document", "page", F.posexplode(found).alias("place", "reference"))


def _titled(rest: Column) -> Column:
    """`TO MAIN SCOPE`, `Template Administration`; not `and this part shall be applied`."""
    bare = F.regexp_replace(rest, f"^(?:{DASH}|[:. \t])+", "")
    small = F.regexp_extract_all(bare, F.lit("[a-z]+"), 0)
    return bare.rlike(r"^[\p{Lu}\p{Nd}(]") & ~F.arrays_overlap(small, F.array(*map(F.lit, STOP)))


def _own_heading(rest: Column, before: Column, above: Column, below: Column, second: Column) -> Column:
    """rest: what follows a reference that opens a unit; before: the units above it, above the last of them; below and second: the next ones."""
    last = F.lower(F.try_element_at(F.regexp_extract_all(above, F.lit("[A-Za-z&]+"), 0), F.lit(-1)))
    runs_on = F.coalesce(last.isin(*RUNS_ON), F.lit(False))
    tail = _plain(rest)
    listed = tail.rlike("^[,;]") | tail.isin(".", ")")
    tail = F.when(tail.startswith("."), _strip(F.substring(tail, 2, 1_000_000))).otherwise(tail)
    titled = F.when(tail == "", ~below.rlike(r"^\p{Ll}")).otherwise(_titled(tail))
    main = F.when(tail == "", below).otherwise(tail)
    target = F.when(main == "TO", F.when(tail == "", second).otherwise(below)).when(main.startswith("TO "), F.substring(main, 4, 1_000_000))
    target = F.lower(F.regexp_extract(F.coalesce(target, F.lit("")), r"^\s*(\S+)", 1))
    return ~runs_on & ~listed & titled & ((before < TOP_UNITS) | ((target != "") & ~target.isin(*STOP)))


def _held(value: Column, name: str) -> Column:
    """value as a column that Spark does not write out again wherever it is read, as it would where it pushes a filter down."""
    return F.explode(F.array(value)).alias(name)


def headings(pages: DataFrame) -> DataFrame:
    """document, page, reference, own_heading, not_applicable: each reference that opens a unit, a line or cell, of pages (document, page, text).

    own_heading: it is the heading of its own section, not a mention. A page that opens units with several references is a list;
    it has no headings, but it can say that an entry is not applicable. A null text has no units. Pages are marked and cut into units once;
    of the units only those that open with a reference and the three around each are looked at.
    """
    rows = pages.where(F.col("text").rlike("(?i)form|exhibit|annex|appendix")).select("document", "page", _held(F.split(marked(F.col("text")), r"[\n|]"), "units"))
    rows = rows.select("document", "page", _held(F.filter(F.transform("units", _strip), lambda u: u != ""), "units"))
    at = lambda i: F.coalesce(F.get("units", i), F.lit(""))
    opens = lambda u: u.startswith("\u0001")

    def lead(unit: Column, i: Column) -> Column:
        # a unit counts once at least, and only the first units are told apart
        above = F.aggregate(F.slice("units", F.lit(1), i), F.lit(0), lambda n, u: n + 1 + F.length(u) - F.length(F.translate(u, "\u0004", "")))
        before = F.when(i >= LIST_TOP_UNITS, i).otherwise(above)
        reference = key(F.regexp_extract(unit, f"^{TOKEN}", 1), F.regexp_extract(unit, f"^{TOKEN}", 2))
        return F.when(opens(unit), F.struct(reference.alias("reference"), before.alias("before"), unit.alias("unit"), at(i - 1).alias("above"), at(i + 1).alias("below"), at(i + 2).alias("second")))

    rows = rows.select("document", "page", _held(F.array_compact(F.transform("units", lead)), "leads"))
    different = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["reference"])))
    listing = (different(F.col("leads")) >= LIST_REFS) | (different(F.filter("leads", lambda x: x["before"] < LIST_TOP_UNITS)) >= LIST_TOP_REFS)
    rows = rows.select("document", "page", listing.alias("listing"), F.explode("leads").alias("lead")).select("document", "page", "listing", "lead.*")
    rest = _strip(F.regexp_replace("unit", f"^{TOKEN}\u0004?", ""))
    own = _own_heading(rest, F.col("before"), _plain(F.col("above")), _plain(F.col("below")), _plain(F.col("second")))
    follow = F.array(F.when(opens(F.col("below")), "").otherwise(_plain(F.col("below"))), F.when(opens(F.col("below")) | opens(F.col("second")), "").otherwise(_plain(F.col("second"))))
    entry = F.filter(F.concat(F.array(_plain(rest)), follow), lambda u: u != "")
    title = F.coalesce(F.get(entry, F.lit(0)), F.lit(""))
    absent = title.rlike(NOT_APPLICABLE) | F.exists(F.slice(entry, 1, 2), lambda u: u.rlike(ONLY_NOT_APPLICABLE))
    return rows.select("document", "page", "reference", (~F.col("listing") & own).alias("own_heading"), (F.col("listing") & absent).alias("not_applicable"))


def absent_documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """reference, mentions, evidence: references that no file is named after, no section is headed by and no list calls not applicable.

    files: filename. evidence: where the first three mentions stand, by document, page and place.
    """
    said = mentions(pages)
    named = files.select(F.explode(F.regexp_extract_all(marked(F.upper(F.translate("filename", "_", " "))), F.lit(TOKEN), 0)).alias("t"))
    present = named.select(key(F.regexp_extract("t", TOKEN, 1), F.regexp_extract("t", TOKEN, 2)).alias("reference"))
    found = present.unionByName(headings(pages).where("own_heading or not_applicable").select("reference")).distinct()
    missing = said.join(found, "reference", "left_anti")
    counts = missing.groupBy("reference").agg(F.count(F.lit(1)).alias("mentions"))
    order = Window.partitionBy("reference").orderBy("document", "page", "place")
    first = missing.withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    where = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "document", "page"))), lambda x: F.concat(x["document"], F.lit("#p"), x["page"])), ", ")
    return counts.join(first.groupBy("reference").agg(where.alias("evidence")), "reference")
