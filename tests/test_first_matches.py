"""First matches against plain Python; pages are searched for the patterns alone."""

import re

from paperloom.operators import packs

PATTERNS = (("bond", "bid bond|bid security"), ("date", r"\bvalid\b"), ("any", "x*"))
PAGES = [
    ("a", 3, "no\n" + "long " * 30 + "BID BOND here\nbid bond"), ("a", 2, "a bid\nbond"), ("a", 5, "bid security first, bid bond then " * 3), ("a", 1, None), ("b", 9, "invalid, valid until\nthen"),
    ("b", 9, "is valid"), ("c", 1, ""), ("c", 2, "\nsay"), (None, 4, "a bid bond"), ("d", None, "valid"), ("d", 1, "valid too"),
]


def test_first_matches(spark, monkeypatch):
    plans, write = [], packs.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(packs, "written", seen)
    pages = spark.createDataFrame(PAGES, "document string, page long, text string").repartition(3)
    want = {}
    for d, p, text in sorted(PAGES, key=lambda r: (r[0] or "", r[1] or 0, r[2] or ""), reverse=True):
        for name, pattern in PATTERNS:
            found = re.search(f"(?i).{{0,40}}(?:{pattern}).{{0,40}}", text or "")
            if found and found[0]:
                want[d, name] = min((p or 0, found[0]), want.get((d, name), (99, "")))
    for few in (packs.FEW, 0):
        monkeypatch.setattr(packs, "FEW", few)
        got = packs.first_matches(pages, PATTERNS)
        assert {(r.document, r.name): (r.page or 0, r.snippet) for r in got.collect()} == want
    packs.first_matches(pages, PATTERNS[:2])
    assert "{0,40}" in plans[0] and "{0,40}" not in plans[-1]
