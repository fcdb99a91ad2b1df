"""The representative sample against a plain greedy one."""

import random
import re

import pytest

from paperloom.functions import text as T
from paperloom.operators import sampling

WORDS = ["audited turnover", "voltage", "subcontractor", "delay", "environment", "key personnel", "past performance", "delivery", "joint venture", "quality assurance", "plain"]


def plain(chunks, most, per_document):
    """[(document, position, new categories)] of one tender's (document, position, page, text)."""
    hits = lambda t: {c for c, p in T.SIGNALS if re.search(p, (t or "").lower())}
    rows = [(d, pos, page, len((t or "").strip()), hits(t)) for d, pos, page, t in sorted(chunks, key=lambda c: c[1])]
    order = list(dict.fromkeys(r[0] for r in rows))
    rows.sort(key=lambda r: order.index(r[0]))
    taken, covered, out = [], set(), []

    def take(r):
        out.append((r[0], r[1], ", ".join(sorted(r[4] - covered))))
        taken.append(r)
        covered.update(r[4])

    for d in order:
        best = min((r for r in rows if r[0] == d), key=lambda r: (-len(r[4]), -r[3], r[2]))
        if len(taken) < most and best[3]:
            take(best)
    while len(taken) < most:
        left = [r for r in rows if r not in taken and r[3] and sum(t[0] == r[0] for t in taken) < per_document]
        if not left:
            break
        best = max(left, key=lambda r: (len(r[4] - covered), len(r[4]), r[3], -r[2]))  # of equal ones the first
        if not best[4] - covered:
            break
        take(best)
    return out


@pytest.mark.parametrize("most, per_document", [(10, 2), (4, 3), (3, 1)])
def test_greedy_cover(spark, most, per_document):
    random.seed(most)
    tenders = {}
    for tender in range(25):
        position = 0
        for document in random.sample(range(100), random.choice([1, 2, 5, 12])):
            for page in range(random.randint(1, 7)):
                text = random.choice([None, "", "  ", *[" ".join(random.choices(WORDS, k=random.randint(1, 4))) for _ in range(6)]])
                tenders.setdefault(tender, []).append((document, position, random.choice([page, 1]), text))
                position += 1
    rows = [(t, *c, "x") for t, chunks in tenders.items() for c in chunks]
    random.shuffle(rows)
    got = {}
    for r in sorted(sampling.representative_chunks(spark.createDataFrame(rows, "tender int, document int, position int, page int, text string, mask string"), most, per_document).collect()):
        got.setdefault(r.tender, []).append((r.document, r.position, r.new_categories))
    want = {t: plain(c, most, per_document) for t, c in tenders.items()}
    assert got == {t: w for t, w in want.items() if w}


def test_no_chunks(spark):
    assert sampling.representative_chunks(spark.createDataFrame([], "tender int, document int, position int, page int, text string")).count() == 0
