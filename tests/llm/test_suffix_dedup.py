"""Removal of repeated byte strings against plain Python, and the suffix sort under it against sorted()."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import induced_sort, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, anchor long, digest long, lo int, body string, `a.b` long"


def plain(texts, length):
    """n_bytes, n_removed, n_spans, digest of what is left, for each text."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone[:-1] & ~np.append(False, gone[:-2]))) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def compare(docs, rows, length, hot):
    got = suffix_dedup.repeated_bytes(docs, length, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(d, *r) for (d, _), r in zip(rows, plain([t for _, t in rows], length))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r[2] for r in want)


@pytest.mark.parametrize("hot", [4096, 2], ids=["shards", "hot"])
def test_odd_texts(spark, hot):
    """Null, empty, short and periodic texts, edited copies, repeated rows, clashing columns; with shards, and with every anchor too hot for one."""
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefé ") for _ in range(7))
    base = "".join(word() for _ in range(90))
    texts = [None, None, "", "short", base, base, "x" * 700, "ab" * 500, base[:300], word() + base[50:] + word()]
    for _ in range(12):
        edited = list(base)
        for _ in range(random.randint(1, 3)):
            edited[random.randrange(len(edited))] = "#"
        texts.append("".join(edited))
    texts += ["".join(word() for _ in range(60)), base[:200] + "".join(word() for _ in range(40)) + base[100:320]]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "b", 4) for d, t in rows], SCHEMA)
    compare(docs, rows, 100, hot)
    assert suffix_dedup.repeated_bytes(docs.limit(0), 100, hot).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    compare(docs, rows, 400, 4096)
    found = docs.join(suffix_dedup.repeated_bytes(docs), "doc_id")
    kept = F.sha2(suffix_dedup.kept_bytes(F.coalesce("text", F.lit("")).cast("binary"), F.col("spans")), 256)
    assert found.where(kept != F.col("kept_sha256")).count() == 0


def test_suffixes_in_order(monkeypatch):
    random.seed(5)
    for most in (5, 40, 1 << 17):
        monkeypatch.setattr(induced_sort, "RANGE", most)
        monkeypatch.setattr(induced_sort, "IN_MEMORY", 64 if most == 40 else 1 << 24)
        for _ in range(60):
            x = [random.randint(1, random.choice([1, 2, 4, 20])) for _ in range(random.randint(0, 90))]
            x = np.array(x * random.choice([1, 3]) + [0], np.int32)
            assert induced_sort.sorted_suffixes(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_repeated_windows(monkeypatch):
    random.seed(6)
    for k in range(150):
        monkeypatch.setattr(induced_sort, "IN_MEMORY", 64 if k % 2 else 1 << 24)
        most, limit = random.choice([1, 2, 4, 30]), random.choice([1, 2, 5, 10, 20])
        base = bytes(random.randint(0, most) for _ in range(60))
        segments = []
        for _ in range(random.randint(1, 8)):
            segment = bytearray(base[random.randint(0, 30) :])
            segment[random.randrange(len(segment))] = random.randint(0, most)
            segments.append(bytes(segment))
        count = Counter(s[i : i + limit] for s in segments for i in range(len(s) - limit + 1))
        starts = np.cumsum([0] + [len(s) + 1 for s in segments])
        want = [o + i for o, s in zip(starts.tolist(), segments) for i in range(len(s) - limit + 1) if count[s[i : i + limit]] > 1]
        text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8)
        assert induced_sort.repeated(text, starts[1:] - 1, limit).tolist() == want
