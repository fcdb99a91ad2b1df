"""Whose tender it is and where: countries and clients by how often a package's pages name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Countries and the words that stand for them; clients and what names them, in order.
COUNTRIES = {
    "Saudi Arabia": ("saudi", "ksa", "kingdom of saudi arabia", "riyadh", "jeddah", "dammam", "maaden", "ma'aden", "ma’aden", "السعودية"),
    "Egypt": ("egypt", "egyptian", "cairo", "egyptian electricity", "eetc", "مصر"),
    "United Arab Emirates": ("united arab emirates", "uae", "dubai", "abu dhabi", "dewa", "الإمارات"),
    "Qatar": ("qatar", "doha", "kahramaa", "قطر"),
    "Kuwait": ("kuwait", "mew kuwait", "الكويت"),
    "Oman": ("oman", "muscat", "oetc", "عمان"),
    "Bahrain": ("bahrain", "manama", "ewa bahrain", "البحرين"),
}
CLIENTS = {
    "Saudi Electricity Company (SEC)": ("saudi electricity company", "saudi electricity co", "sec "),
    "National Grid SA": ("national grid", "ngsa"),
    "Ma'aden": ("ma'aden", "maaden", "ma’aden"),
    "NEOM": ("neom",),
    "Saudi Aramco": ("saudi aramco", "aramco"),
    "Egyptian Electricity Transmission Company (EETC)": ("egyptian electricity transmission", "eetc"),
    "Dubai Electricity and Water Authority (DEWA)": ("dewa", "dubai electricity"),
    "KAHRAMAA": ("kahramaa",),
    "OETC": ("oetc", "oman electricity transmission"),
}
CLIENT_LINE = r"(?i)\b(?:client|owner|employer|purchaser|contracting\s+authority)\s*[:\-]\s*([A-Z][A-Za-z&.,'’() -]{3,70})"

#: A word, Arabic marks included, or what stands between words.
PART = r"[\p{L}\p{N}_؀-ۿ]+|[^\p{L}\p{N}_؀-ۿ]+"


def parts_of(key: str) -> list[str]:
    """The parts of a name: words and what is between them."""
    import regex

    return regex.findall(PART, key)


def named(texts: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """texts with name and n: how often each text's words hold the words that stand for each of names; only those that occur.

    Words count as wholes: Oman is not in Roman. Texts are cut into parts once; where a part begins a name, the next parts are joined up to
    each length that names have and looked up in the table of names by hash. That table is as large as the list given.
    """
    known = [key for keys in names.values() for key in keys]
    first = sorted({parts_of(key)[0] for key in known})
    lengths = sorted({len(parts_of(key)) for key in known})
    spark = texts.sparkSession
    table = F.broadcast(spark.createDataFrame([(key, name, i) for i, name in enumerate(names) for key in names[name]], "gram string, name string, listed int"))
    parts = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(PART), 0)
    rows = texts.withColumn("parts", parts)
    starts = F.filter(F.transform("parts", lambda p, i: F.when(p.isin(first), i + 1)), lambda i: i.isNotNull())
    grams = F.flatten(F.transform(starts, lambda i: F.array_compact(F.array(*[F.when(i + n - 1 <= F.size("parts"), F.array_join(F.slice("parts", i, F.lit(n)), "")) for n in lengths]))))
    ends = rows.select(*texts.columns, F.explode(F.transform(F.array_distinct(grams), lambda g: F.struct(g.alias("gram"), F.size(F.filter(grams, lambda x: x == g)).alias("n")))).alias("g"))
    return ends.select(*texts.columns, "g.gram", "g.n").join(table, "gram").groupBy(*texts.columns, "name", "listed").agg(F.sum("n").alias("n"))


def countries(texts: DataFrame) -> DataFrame:
    """tender, country, mentions: the country that the texts (tender, place, weight, text) of each tender name most, weighed.

    Of equal ones that which is named first, by place, then in the order of the list. Tenders that name none are left out; place is a text's own.
    """
    found = named(texts.select("tender", "place", "weight", "text"), COUNTRIES)
    sums = found.groupBy("tender", F.col("name").alias("country"), "listed").agg(F.sum(F.col("n") * F.col("weight")).alias("mentions"), F.min("place").alias("first"))
    best = F.row_number().over(Window.partitionBy("tender").orderBy(F.col("mentions").desc(), "first", "listed"))
    return sums.withColumn("nth", best).where("nth = 1").select("tender", "country", "mentions")


def client_key(name: Column) -> Column:
    """One form for a client's names: that of the list if a name of it is inside, else letters and digits in lower case."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    known = []
    for client, keys in CLIENTS.items():
        inside = F.lit(False)
        for key in keys:
            inside = inside | low.contains(key)
        known.append(F.when(inside, F.lit(client)))
    return F.coalesce(*known, F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")))


def clients(pages: DataFrame) -> DataFrame:
    """tender, client, mentions, document, page: the client that the pages (tender, place, document, page, text) of each tender name most.

    With its first mention; of equal ones that which is named first, then the first of the list. If none of the list is named, the name on
    the first line such as `Client: ...`, without mentions. Tenders without either are left out. All pages are read; place is a page's own.
    """
    low = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    rows = pages.withColumn("low", F.when(low.rlike("|".join(k for keys in CLIENTS.values() for k in keys)), low))  # most pages name none
    counted = [F.struct(F.lit(c).alias("client"), F.lit(i).alias("listed"), sum((F.regexp_count("low", F.lit(k)) for k in keys), F.lit(0)).alias("n")) for i, (c, keys) in enumerate(CLIENTS.items())]
    found = rows.where("low is not null").select("tender", "place", "document", "page", F.explode(F.array(*counted)).alias("c")).select("*", "c.*").where("n > 0")
    sums = found.groupBy("tender", "client", "listed").agg(F.sum("n").alias("mentions"), F.min(F.struct("place", "document", "page")).alias("first"))
    best = F.row_number().over(Window.partitionBy("tender").orderBy(F.col("mentions").desc(), "first.place", "listed"))
    sums = sums.withColumn("nth", best).where("nth = 1").select("tender", "client", "mentions", "first.document", "first.page")
    line = F.regexp_replace(F.regexp_extract("text", CLIENT_LINE, 1), r"^[ .,-]+|[ .,-]+$", "")
    labelled = pages.where(F.col("text").rlike(CLIENT_LINE)).groupBy("tender").agg(F.min(F.struct("place", line.alias("client"), "document", "page")).alias("first"))
    labelled = labelled.select("tender", "first.client", F.lit(None).cast("long").alias("mentions"), "first.document", "first.page")
    return sums.unionByName(labelled.join(sums.select("tender"), "tender", "left_anti"))


def country_allowed(country: Column, allowed: Column) -> Column:
    """Whether one of allowed begins the country, or is begun by what stands before its first comma; without case. False for an empty or null list."""
    low = F.lower(F.coalesce(country, F.lit("")))
    before = F.regexp_extract(low, "^[^,]*", 0)
    return F.coalesce(F.exists(allowed, lambda a: (a != "") & (low.startswith(F.lower(a)) | F.lower(a).startswith(before))), F.lit(False))
