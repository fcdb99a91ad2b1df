"""Notices against capabilities, reminders, list orders, quotas and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least match of a strong notice, least of a fair one, days below which a deadline counts half.
STRONG, FAIR, CLOSE_DAYS = 75, 50, 14
# Days before a deadline, and before a task's due date, from which reminders are given.
DEADLINE_SOON, DEADLINE_URGENT, TASK_SOON = 7, 2, 3


def radar(notices: DataFrame, capability: dict, today: str) -> DataFrame:
    """Match of notices (id, work_type, kv, country, deadline) with one account's capability: match, status, days_left.

    capability: work_types, max_kv, countries; an absent part makes its factor unknown. The match is the percentage
    of known factors met; a deadline within two weeks counts half, and alone tells nothing. One projection, no join.
    """
    days = F.datediff(F.col("deadline"), F.lit(today).cast("date")).cast("long")
    met = lambda test: test.cast("double")
    kinds, most, countries = capability.get("work_types"), capability.get("max_kv"), capability.get("countries")
    parts: dict[str, Column] = {
        "work_type": met(F.col("work_type").isin(*kinds)) if kinds else F.lit(None).cast("double"),
        "voltage": met(F.col("kv") <= most) if most else F.lit(None).cast("double"),
        "country": met(F.lower("country").isin(*[c.lower() for c in countries])) if countries else F.lit(None).cast("double"),
        "deadline": F.when(days < 0, 0.0).when(days < CLOSE_DAYS, 0.5).when(days >= CLOSE_DAYS, 1.0),
    }
    rows = notices.withColumns({f"f_{k}": v for k, v in parts.items()})
    n = sum((F.col(f"f_{k}").isNotNull().cast("int") for k in parts), F.lit(0))
    met_sum = sum((F.coalesce(F.col(f"f_{k}"), F.lit(0.0)) for k in parts), F.lit(0.0))
    known = (n > 1) | ((n == 1) & F.col("f_deadline").isNull())
    rows = rows.withColumn("match", F.when(known & F.lit(bool(capability)), F.bround(100 * met_sum / n, 0).cast("long")))
    blocked = F.coalesce(F.col("f_voltage") == 0, F.lit(False)) | F.coalesce(F.col("f_work_type") == 0, F.lit(False))
    status = F.when(F.col("match").isNull(), "INSUFFICIENT_DATA").when(blocked | (F.col("match") < FAIR), "WEAK").when(F.col("match") >= STRONG, "STRONG").otherwise("FAIR")
    return rows.select("id", "match", status.alias("status"), days.alias("days_left"))


def radar_summary(matched: DataFrame) -> DataFrame:
    """Notices, strong ones, and those that close within a week, of radar()."""
    return matched.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "STRONG").alias("strong"), F.count_if(F.col("days_left").between(0, 7)).alias("closing"))


def reminders(tenders: DataFrame, tasks: DataFrame, todo: DataFrame, today: str) -> DataFrame:
    """tender_id, kind, n, priority, due for open tenders (tender_id, deadline), their open tasks (tender_id, due) and to-do counts (tender_id, todo)."""
    day = F.lit(today).cast("date")
    left = F.datediff("deadline", day)
    near = left.between(0, DEADLINE_SOON)
    out = lambda kind, n, priority: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), priority.alias("priority"))
    high, medium = F.lit("HIGH"), F.lit("MEDIUM")
    own = F.array_compact(F.array(F.when(left < 0, out("deadline-passed", -left, high)), F.when(near, out("deadline-soon", left, F.when(left <= DEADLINE_URGENT, high).otherwise(medium))), F.when(near & (F.col("todo") > 0), out("checklist-open", F.col("todo"), high))))
    first = tenders.join(todo, "tender_id", "left").select("tender_id", F.col("deadline").alias("due"), F.inline(own))
    days = F.datediff("due", day)
    second = tasks.where("due is not null").join(tenders.select("tender_id"), "tender_id", "left_semi").withColumn("d", days).where(F.col("d") <= TASK_SOON)
    second = second.select("tender_id", "due", F.when(F.col("d") < 0, "task-overdue").otherwise("task-due").alias("kind"), F.abs("d").cast("long").alias("n"), F.when(F.col("d") < 0, high).otherwise(medium).alias("priority"))
    return first.unionByName(second)


def approvals(rows: DataFrame) -> DataFrame:
    """position of rows (id, decided_at, deadline): waiting ones by deadline, those without one last, then decided ones newest first.

    Positions are numbered within waiting and decided apart. Rows are counted per day and 1,000 ranges of ids, only the
    counts are ordered as a whole, and rows are numbered within their day and range.
    """
    rows = rows.withColumn("waiting", F.col("decided_at").isNull())
    day = F.when(F.col("waiting"), F.datediff("deadline", F.lit("1970-01-01").cast("date"))).otherwise(-F.datediff("decided_at", F.lit("1970-01-01").cast("date")))
    at = F.coalesce(day, F.lit(2**31 - 1))
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    part = F.floor((F.col("id") - F.lit(lo)) / F.lit(max((hi or 0) - (lo or 0), 1)) * 999)
    rows = rows.select("id", "waiting", at.alias("at"), F.coalesce(part, F.lit(-1)).cast("int").alias("part"))
    counts = rows.groupBy("waiting", "at", "part").agg(F.count(F.lit(1)).alias("c"))
    days = counts.groupBy("waiting", "at").agg(F.sum("c").alias("d"))
    days = days.select("waiting", "at", (F.sum("d").over(Window.partitionBy("waiting").orderBy("at")) - F.col("d")).alias("earlier"))
    starts = counts.join(days, ["waiting", "at"]).select("waiting", "at", "part", (F.col("earlier") + F.sum("c").over(Window.partitionBy("waiting", "at").orderBy("part")) - F.col("c")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("waiting", "at", "part").orderBy("id"))
    return rows.withColumn("nth", nth).join(starts, ["waiting", "at", "part"]).select("id", "waiting", (F.col("start") + F.col("nth")).alias("position"))


def roman(text: Column) -> Column:
    """Value of a Roman numeral: each sign counts negative before a larger one."""
    value = F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv])
    signs = F.transform(F.split(text, ""), lambda c: F.element_at(value, c))
    after = F.concat(F.slice(signs, 2, F.greatest(F.size(signs) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(signs, after, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda t, v: t + v)


def natural_order(rows: DataFrame) -> DataFrame:
    """Sort columns of rows (reference): kind, class (numbers, Roman numerals, letters), number and rest; rows sorted by them read naturally."""
    kind, tail = F.split_part("reference", F.lit(" "), F.lit(1)), F.split_part("reference", F.lit(" "), F.lit(2))
    number = F.regexp_extract(tail, r"^(\d+)", 1)
    is_roman = tail.rlike("^[IVXLCDM]+$")
    cls = F.when(number != "", 0).when(is_roman, 1).otherwise(2)
    value = F.when(number != "", number.cast("int")).when(is_roman, roman(tail)).otherwise(0)
    return rows.select("reference", kind.alias("kind"), cls.alias("class"), value.alias("number"), tail.alias("rest"))


def storage(accounts: DataFrame, files: DataFrame) -> DataFrame:
    """used and free space of accounts (account, quota) from files (account, size); free is never below 0."""
    used = files.groupBy("account").agg(F.sum(F.coalesce("size", F.lit(0))).alias("used"))
    rows = accounts.join(used, "account", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.select("account", "quota", "used", F.greatest(F.col("quota") - F.col("used"), F.lit(0)).alias("free"))


def file_inventory(files: DataFrame) -> DataFrame:
    """files, characters, languages and scanned (mean text below 100 characters) of each tender of files (tender_id, lang, text)."""
    n = F.coalesce(F.length("text"), F.lit(0))
    rows = files.groupBy("tender_id").agg(F.count(F.lit(1)).alias("files"), F.sum(n).alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))
    return rows.withColumn("scanned", F.col("chars") < 100 * F.col("files"))


def document_status(pages: DataFrame) -> DataFrame:
    """COMPLETE, PARTIAL or FAILED for documents of pages (document, page, text, failed), with their failed pages (20 shown).

    FAILED: every page failed with at most 50 characters kept; PARTIAL: some failed, or at most 50 characters in all.
    The shown pages are the 20 least, kept by rank, so that no document's pages are gathered whole.
    """
    per = pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"), F.count_if("failed").alias("n_failed"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"))
    nth = F.row_number().over(Window.partitionBy("document").orderBy("page"))
    shown = pages.where("failed").withColumn("nth", nth).where("nth <= 20").groupBy("document").agg(F.array_join(F.array_sort(F.collect_list("page")), ",").alias("failed_pages"))
    few = F.col("chars") <= 50
    status = F.when((F.col("n_failed") == F.col("pages")) & few, "FAILED").when((F.col("n_failed") > 0) | few, "PARTIAL").otherwise("COMPLETE")
    return per.join(shown, "document", "left").select("document", "pages", "n_failed", "chars", status.alias("status"), F.coalesce("failed_pages", F.lit("")).alias("failed_pages"))
