"""Personal data: fixed patterns, extended by bootstrapped contextual extraction.

The fixed patterns give seed entities. The two words before an entity, the one before and the one after, each
with the entity's shape, are its lexical patterns. Shapes are those that seeds have: an address sign (@, or
spelt out), four numbers up to 255 with dots, plain or in brackets, and as many digits as phones or cards have,
the latter with their check digit. In a graph of patterns and instances, Spark scores in turn
which share of all that a pattern holds in the corpus are instances of a kind, and how well an instance's
patterns are trusted. Trusted patterns discover identifiers that no fixed pattern knows; their spans are added.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect
from collections.abc import Iterator
from itertools import chain
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table, split_join

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this share of what it holds, and this many distinct instances, to be trusted.
CONFIDENCE, SUPPORT, ROUNDS = 0.5, 3, 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Sought from the start of a word only, so that a long word costs its length once.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
WORD = re.compile(r"\S+")
#: A token that is a digit group, such as one of (555) 123 4567, and one after which no further group belongs to it.
GROUP = re.compile(r"[(\[+]*[0-9][0-9()\[\].+/-]*[,;:!?]*")
#: The sign between the parts of a spelt-out address, its dots, and what follows the sign.
AT = re.compile(r"(?i)[\[({<][ \t]?(?:at|@)[ \t]?[\])}>]|(?<=[ \t])at(?=[ \t])")
BRACKETED = re.compile(r"(?i)\w[\[({<]at[\])}>]\w")
DOT = r"(?i:[ \t]dot[ \t]|[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?|\.)"
DOT_BEFORE = re.compile(DOT + r"\Z")
SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+")
#: Longer instances and words of a context are known by their digest.
LONG = 64
#: Digits of a phone, also without its country code, and of a card.
PHONE_DIGITS, CARD_DIGITS = range(7, 16), range(16, 20)
EDGES = ".,;:!?()[]{}<>\"'|*#&$%"


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four dotted numbers, by the parts of each run of digits and dots."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, places, at = run.group().split("."), [], run.start()
        for p in parts:
            places.append(at)
            at += len(p) + 1
        i = 0
        while i + 4 <= len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield places[i], places[i + 3] + len(parts[i + 3])
                i += 4
            else:
                i += 1


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind and start; ends are exclusive."""
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    out += [(1, *x) for x in _ips(text)] if "." in text else []
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _name(word: str) -> str:
    return word if len(word) <= LONG else sha256(word.encode("utf-8", "replace")).hexdigest()


class Words:
    """The words of a text by their places, found once; a word's name is made once however many entities stand beside it."""

    def __init__(self, text: str):
        self.text, self.names = text, {}
        self.bounds = array("q", chain.from_iterable(m.span() for m in WORD.finditer(text)))  # start and end in turn

    def name(self, i: int, missing: str) -> str:
        """The word whose start is bounds[i], in lower case; missing if there is none."""
        if not 0 <= i < len(self.bounds):
            return missing
        if i not in self.names:
            self.names[i] = _name(self.text[self.bounds[i] : self.bounds[i + 1]].lower())
        return self.names[i]

    def before(self, at: int) -> str:
        """The two words before the word in which position at lies, by a space; ^ for a missing one."""
        i = bisect(self.bounds, at) - 1
        return f"{self.name(i - 4, '^')} {self.name(i - 2, '^')}"

    def after(self, end: int) -> str:
        """The word after the one that holds the character before end; $ if there is none."""
        return self.name(bisect(self.bounds, end - 1) + 1, "$")


def shape(word: str) -> str:
    """at, dots, card or phone; empty for what has no seed's shape."""
    if "@" in word or BRACKETED.search(word):
        return "at"
    digits = re.sub("[^0-9]", "", word)
    if len(digits) < 4 or any(map(str.isalpha, word)):
        return ""
    parts = word.replace("[.]", ".").replace("(.)", ".").split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts):
        return "dots"
    if len(digits) in CARD_DIGITS:
        return "card" if luhn(digits) else ""
    return "phone" if len(digits) in PHONE_DIGITS else ""


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses such as user at example dot com or user [at] example.com."""
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in " \t":
            start -= 1
        first = start
        while True:
            while first > done and text[first - 1] in LOCAL:
                first -= 1
            dot = DOT_BEFORE.search(text, max(done, first - 9), first)
            if dot is None or dot.start() <= done or text[dot.start() - 1] not in LOCAL:
                break
            first = dot.start()
        after = m.end()
        while text[after : after + 1] in (" ", "\t"):
            after += 1
        domain = SPELT_DOMAIN.match(text, after) if first < start else None
        if domain:
            yield first, domain.end()
            done = domain.end()


def _candidates(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, where its tokens start) of digit-group runs and other tokens of a seed's shape that touch nothing covered."""

    def trimmed(a: int, b: int) -> Iterator[tuple[int, int, int]]:
        word = text[a:b].strip(EDGES)
        if not shape(word):
            return
        start = text.index(word, a)
        end = start + len(word)
        if start > a and text[start - 1] + ")]"["([".find(text[start - 1])] in ("()", "[]") and ")]"["([".index(text[start - 1])] in word:
            start -= 1  # (555) 123
        yield start, end, a

    run: tuple[int, int] | None = None
    i = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        free = i == len(covered) or covered[i][0] >= b
        group = free and GROUP.fullmatch(text, a, b)
        if run and group and text[run[1] - 1] not in ",;:!?" and not text[run[1] : a].strip(" \t"):
            run = run[0], b
            continue
        if run:
            yield from trimmed(*run)
        run = (a, b) if group else None
        if free and not group:
            yield from trimmed(a, b)
        elif not free:  # what a covered span leaves of its token
            word = m.group().strip(EDGES)
            at = a + m.group().index(word)
            if word and (covered[i][0] >= at + len(word) or covered[i][1] <= at):
                yield from trimmed(a, b)
    if run:
        yield from trimmed(*run)


def scan(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Fixed spans, and the occurrences (kind or -1, start, end, instance, context) that can take part in bootstrapping."""
    text = text or ""
    marked = re.search("[0-9@]", text)
    base = fixed_spans(text) if marked else []
    shapes = ("at", "dots", "card", "phone")
    covered: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if covered and a < covered[-1][1]:
            covered[-1] = covered[-1][0], max(b, covered[-1][1])
        else:
            covered.append((a, b))

    def free(a: int, b: int) -> bool:
        i = max(bisect(covered, (a,)) - 1, 0)
        return all(y <= a or x >= b for x, y in covered[i : i + 2])

    spelt = [(a, b) for a, b in _spelt(text) if free(a, b)]
    covered = sorted(covered + spelt)
    found = [(a, b, a, "at") for a, b in spelt] + [(a, b, t, shape(text[a:b])) for a, b, t in (_candidates(text, covered) if marked else [])]
    places = [(k, a, b, a, shapes[k]) for k, a, b in base] + [(-1, *x) for x in sorted(found)]
    words = Words(text if places else "")
    return base, [(k, a, b, _name(text[a:b].lower()), words.before(token), words.after(b), form) for k, a, b, token, form in places]


SEEN_NAMES = ("k", "start", "end", "inst", "ctx", "next", "shape")
SPAN = pa.struct([("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SEEN = pa.struct([("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), *[(n, pa.string()) for n in SEEN_NAMES[3:]]])
SCHEMA = "row long, doc_id long, base array<struct<k:int,start:long,end:long>>, seen array<struct<k:int,start:long,end:long,inst:string,ctx:string,next:string,shape:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = [scan(t.as_py()) for t in batch.column(1)]
        base = [[dict(zip(("k", "start", "end"), x)) for x in b] for b, _ in found]
        seen = [[dict(zip(SEEN_NAMES, x)) for x in s] for _, s in found]
        rows = pa.array(range(row, row + len(found)), pa.int64())
        row += len(found)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(seen, pa.list_(SEEN))], ["row", "doc_id", "base", "seen"])


def occurrences(scanned: DataFrame) -> DataFrame:
    """row, k, start, end, inst, pattern: one row for each of the three patterns of each occurrence; words hold no space, so patterns are told apart."""
    rows = scanned.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    two, one, right = F.col("ctx"), F.element_at(F.split("ctx", " "), 2), F.col("next")
    patterns = [F.concat_ws(" ", *p, F.col("shape")) for p in ((two, F.lit("_")), (one, F.lit("_")), (F.lit("_"), right))]
    return rows.withColumn("pattern", F.explode(F.array(*patterns))).drop("ctx", "next", "shape")


def _best(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, kind, value) with the kind of the greatest value for each key, the first listed of equal ones."""
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(value), -F.col("kind"))).alias("b"))
    return best.select(key, (-F.col("b.col2")).alias("kind"), F.col(f"b.{value}").alias(value))


def discover(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, k, start, end of the spans that trusted patterns add; a span has one kind.

    The patterns of each round are those of all instances scored so far, seeds and found. Frequent patterns and
    instances are joined on the map side, so that none is gathered in one task.
    """
    edges = shared_table(occurrences(scanned).groupBy("pattern", "inst", "k").agg(F.count(F.lit(1)).alias("n")), "edges")
    # with fewer instances of any kind a pattern cannot have the support
    many = edges.groupBy("pattern").agg(F.countDistinct("inst").alias("d"), F.sum("n").alias("total")).where(F.col("d") >= SUPPORT)
    graph = shared_table(split_join(edges, shared_table(many.select("pattern", "total"), "many"), "pattern"), "graph")
    seeds = edges.where("k >= 0").groupBy("inst").agg(F.min("k").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = scores = shared_table(seeds, "seeds")
    unknown = graph.where("k < 0")
    for _ in range(rounds):
        known = split_join(graph, scores, "inst").groupBy("pattern", "kind")
        known = known.agg(F.sum(F.col("score") * F.col("n")).alias("weight"), F.countDistinct("inst").alias("support"), F.max("total").alias("total"))
        trusted = known.withColumn("trust", F.col("weight") / F.col("total")).where((F.col("support") >= SUPPORT) & (F.col("trust") >= CONFIDENCE))
        trusted = shared_table(_best(trusted, "pattern", "trust"), "trusted")
        found = split_join(unknown, trusted, "pattern").groupBy("inst", "kind").agg(F.max("trust").alias("score"))
        found = _best(found, "inst", "score").join(seeds, "inst", "left_anti")
        scores = shared_table(seeds.unionByName(found), "scores")
    new = shared_table(scores.join(seeds, "inst", "left_anti").select("inst", F.col("kind").alias("found")), "new")
    rows = scanned.select("row", F.explode("seen").alias("s")).select("row", "s.*").where("k < 0").select("row", "start", "end", "inst")
    return split_join(rows, new, "inst").select("row", F.col("found").alias("k"), "start", "end")


def _joined(spans: F.Column) -> F.Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base (text of the fixed spans), spans (all), added.

    Spans are kind:start:end in code points, end exclusive, by kind and start. A null text counts as empty.
    Null doc_ids and repeated rows are kept; no rows give no rows; other columns of docs are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = shared_table(plain.mapInArrow(_scan, SCHEMA), "scanned")
    added = discover(scanned, rounds).groupBy("row").agg(F.collect_list(F.struct("k", "start", "end")).alias("more"))
    rows = scanned.select("row", "doc_id", "base").join(added, "row", "left")
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    none = F.expr("cast(array() as array<struct<k:int,start:bigint,end:bigint>>)")
    every = F.array_sort(F.concat("base", F.coalesce("more", none)))
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], _joined(F.col("base")).alias("base"), _joined(every).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).alias("added"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


SQL: dict[str, str] = {}
QUERIES = {"op5_personal_data": op5_personal_data}
