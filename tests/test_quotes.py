"""Upper and lower case are SQL's, a character for a character, so that a quote in capitals is found in its text."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.plans import packs

#: DuckDB has no pairs of letters that are new in Unicode 16.
NEW = ["\u019b", "\u0264", "\u1c89", "\u1c8a", *map(chr, range(0xA7CB, 0xA7DD)), *map(chr, range(0x10D50, 0x10D86))]
TEXTS = ["Die Straße führt zum Schloß am Fluß", "ßßß", "ﬁn ﬀ ŉ ǰ", "ΑΣ ΑΣΑ ΌΔΟΣ", "İstanbul ist groß", "plain", "", "𝔘 𐐨 ß"]


def test_case_of_all_characters_is_that_of_sql(spark):
    held = pd.DataFrame({"s": [*TEXTS, *(c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c not in NEW)]})
    want = duckdb.sql("SELECT s, upper(s) AS u, lower(s) AS l FROM held").df()
    found = spark.createDataFrame(held).select("s", T.upper(F.col("s")).alias("u"), T.lower(F.col("s")).alias("l")).toPandas()
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_a_quote_in_capitals_holds(spark, tmp_path):
    rows = [(4 * i + 1, TEXTS[i % len(TEXTS)] * 4, "de", "s", 0) for i in range(33 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(packs.ORACLE_SQL["quote_checked"]).fetchall()
    found = [tuple(r) for r in packs.quote_checked(spark, str(tmp_path)).select("id", "verdict").collect()]
    assert sorted(found) == sorted(want)
