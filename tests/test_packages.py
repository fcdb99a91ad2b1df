"""Ambiguity groups against a plain form; decision packs and snapshots by hand."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import ambiguity, snapshots

SCHEMA = "id long, kind string, document string, page int, description string, norm string"


def plain(signals, least):
    """{id: group id}: equal normal forms first, then the first like one of those that stand on the same single page."""
    norm = lambda t: " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split())
    exact = {}
    for s in sorted(signals):
        exact.setdefault((s[1], s[2], norm(s[4])), []).append(s)
    leaders, group = {}, {}
    for (kind, document, text), held in sorted(exact.items(), key=lambda x: min(x[1])):
        first, pages, words = min(held)[0], {s[3] for s in held}, set(text.split())
        own = first
        if len(pages) == 1:
            block = leaders.setdefault((kind, document, *pages), [])
            near = [i for i, w in block if words and w and len(w & words) / len(w | words) >= least]
            own = near[0] if near else first
            if own == first:
                block.append((first, words))
        group |= {s[0]: own for s in held}
    return group


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_groups(spark, least):
    random.seed(8)
    words = "the price of steel is to be confirmed by owner later on".split()
    signals = []
    for i in random.sample(range(5000), 220):
        text = words[: random.randint(8, 12)]
        if random.random() < 0.6:
            text = [w if random.random() < 0.9 else random.choice("xyz") for w in text]
        description = random.choice([" ".join(text), " ".join(text).upper() + ".", "", None] if random.random() < 0.2 else [" ".join(text)])
        signals.append((i, random.choice("kl"), random.choice(["a", "b", None]), random.choice([1, 1, 2]), description, "x"))
    rows = spark.createDataFrame(signals, SCHEMA).repartition(3)
    groups, members = ambiguity.ambiguity_groups(rows, least)
    want = plain([(*s[:2], s[2] or "", *s[3:]) for s in signals], least)
    assert {r.id: r.group_id for r in members.collect()} == want
    sizes = {g: list(want.values()).count(g) for g in want.values()}
    assert {r.group_id: r.signals for r in groups.collect()} == sizes and len(sizes) < len(signals)
    longest = {g: max((len(s[4]) for s in signals if want[s[0]] == g and s[4] is not None), default=None) for g in sizes}
    assert {r.group_id: None if r.description is None else len(r.description) for r in groups.collect()} == longest
    report = ambiguity.audit(rows, groups, members).first()
    assert (report.raw, report.groups, report.whole) == (len(signals), len(sizes), True)
    assert not ambiguity.audit(rows, groups, members.where("id % 2 = 0")).first().whole
    assert not ambiguity.audit(rows, groups, members.union(members)).first().whole


def test_no_signals(spark):
    none = spark.createDataFrame([], SCHEMA)
    groups, members = ambiguity.ambiguity_groups(none)
    assert groups.count() == 0 and tuple(ambiguity.audit(none, groups, members).first()) == (0, 0, 0.0, True)


def test_pack_has_one_row_a_tender(spark):
    tenders = spark.range(1, 4).withColumnRenamed("id", "tender_id")
    single = spark.createDataFrame([(1, "BID"), (3, "NO_BID"), (9, "BID")], "tender_id long, decision string")
    rows = spark.createDataFrame([(1, i, f"g{i}") for i in range(6)] + [(2, 0, None)], "tender_id long, line int, text string")
    pack = {r.tender_id: r for r in snapshots.decision_pack(tenders, {"decision": single}, {"gaps": (rows, [F.col("line").desc()], 2), "same": (rows, ["line"], 9)}).collect()}
    assert len(pack) == 3 and pack[1].decision.decision == "BID" and pack[2].decision is None and pack[3].gaps is None
    assert pack[1].gaps.n == 6 and [g.text for g in pack[1].gaps.rows] == ["g5", "g4"] and len(pack[1].same.rows) == 6 and pack[2].gaps.rows[0].text is None


def test_snapshots_keep_old_runs_and_forms(spark, tmp_path):
    path = str(tmp_path / "s")
    one = spark.createDataFrame([(1, ("BID",)), (2, ("REVIEW",))], "tender_id long, decision struct<decision:string>")
    two = spark.createDataFrame([(2, ("NO_BID", "HIGH"), 5)], "tender_id long, decision struct<decision:string,confidence:string>, risks int")
    snapshots.append_snapshot(one, path, 1, "1.0")
    snapshots.append_snapshot(two, path, 10, "2.0")
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.append_snapshot(two, path, 10, "2.0")
    got = {r.tender_id: r for r in snapshots.latest(spark, path, {"risks": F.lit(0)}).collect()}
    assert (got[1].run, got[1].analysis_version, got[1].decision.decision, got[1].decision.confidence, got[1].risks) == (1, "1.0", "BID", None, 0)
    assert (got[2].run, got[2].analysis_version, got[2].decision.decision, got[2].decision.confidence, got[2].risks) == (10, "2.0", "NO_BID", "HIGH", 5)
    assert snapshots.snapshots(spark, path).count() == 3
