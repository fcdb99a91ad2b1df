"""Countries and clients against a plain count."""

import re

from pyspark.sql import functions as F

from paperloom.operators import owners

TEXTS = [
    (1, 0, 5, "Supply to the Kingdom of Saudi Arabia"), (1, 1, 1, "Cairo, Cairo, Egypt and egyptian Electricity; EETC"), (1, 2, 1, "Roman law, womanly"),
    (2, 0, 5, "Roman law"), (2, 1, 1, None), (3, 0, 5, ""), (3, 1, 1, "في مصر وقطر و قطر، والسعودية السعودية"), (4, 0, 1, "Doha. Muscat."), (4, 1, 1, "Muscat Doha"),
    (5, 0, 1, "Ma'aden and ma’aden; saudi_arabia; abu  dhabi; Abu Dhabi"), (6, 3, 1, "MEW Kuwait"), (7, 0, 1, "x " * 30_000 + "oman"),
]


def test_countries(spark):
    want = {}
    for tender in {t[0] for t in TEXTS}:
        counts = {}
        for _, _, weight, text in sorted(t[:3] + ((t[3] or "").lower(),) for t in TEXTS if t[0] == tender):
            for country, keys in owners.COUNTRIES.items():
                n = sum(len(re.findall(rf"(?<![\w؀-ۿ]){re.escape(k)}(?![\w؀-ۿ])", text)) for k in keys)
                if n:
                    counts[country] = counts.get(country, 0) + n * weight
        if counts:
            best = max(counts, key=counts.get)
            want[tender] = (best, counts[best])
    got = owners.countries(spark.createDataFrame([(*t, "x") for t in TEXTS], "tender int, place int, weight int, text string, gram string").repartition(4)).collect()
    assert {r.tender: (r.country, r.mentions) for r in got} == want
    assert want[4][0] == "Qatar" and 2 not in want and want[3][0] == "Saudi Arabia"


def test_clients(spark):
    pages = [
        (1, 0, "a.pdf", 1, "Owner: Some Works Co. Ltd.\nfor NEOM"), (1, 1, "a.pdf", 2, "Saudi Aramco, ARAMCO"), (1, 2, "b.pdf", 1, "neom bay and Neom"),
        (2, 0, "a.pdf", 1, "nothing"), (2, 1, "a.pdf", 2, "Contracting  Authority - The Water Board, -\nClient: Other"), (2, 2, "a.pdf", 3, "Client: Later"),
        (3, 0, "a.pdf", 1, None), (3, 1, "a.pdf", 2, ""), (4, 0, "a.pdf", 1, "DEWA"), (4, 1, "a.pdf", 2, "national grid"), (5, 0, "a.pdf", 1, "issued by SEC"),
    ]
    rows = spark.createDataFrame([(*p, 1) for p in pages], "tender int, place int, document string, page int, text string, low int").repartition(3)
    got = {r.tender: (r.client, r.mentions, r.document, r.page) for r in owners.clients(rows).collect()}
    assert got == {
        1: ("NEOM", 3, "a.pdf", 1),
        2: ("The Water Board", None, "a.pdf", 2),
        4: ("Dubai Electricity and Water Authority (DEWA)", 1, "a.pdf", 1),
        5: ("Saudi Electricity Company (SEC)", 1, "a.pdf", 1),
    }


def test_names(spark):
    names = spark.createDataFrame([("  ARAMCO Overseas",), ("The Water-Board, Ltd.",), (None,), ("sector nine",), ("The SEC",)], "name string")
    assert [r[0] for r in names.select(owners.client_key(F.col("name"))).collect()] == ["Saudi Aramco", "the water board ltd", "", "sector nine", "Saudi Electricity Company (SEC)"]
    rows = spark.createDataFrame([("Egypt", ["egy"]), ("Qatar, Doha", ["Qatar state"]), ("Oman", ["", "Kuwait"]), (None, ["Oman"]), ("Oman", [])], "c string, a array<string>")
    assert [r[0] for r in rows.select(owners.country_allowed(F.col("c"), F.col("a"))).collect()] == [True, True, False, True, False]


def test_no_texts(spark):
    assert owners.countries(spark.createDataFrame([], "tender int, place int, weight int, text string")).count() == 0
    assert owners.clients(spark.createDataFrame([], "tender int, place int, document string, page int, text string")).count() == 0
