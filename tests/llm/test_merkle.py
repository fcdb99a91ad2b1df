"""The Merkle manifest against SQL and a plain Python tree."""

import hashlib
import zlib

import duckdb
import pytest

from paperloom.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, n long, digest string, altered string, row long, one long, path string, `a.b` long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The top of the tree over nodes, and each node's (left, right) at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            lo = k - k % 16
            paths[i].append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 16])))
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return (nodes or [None])[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, paths = [], {}
    for s in names:
        groups[s].sort(key=lambda g: g[:3])
        top, paths[s] = climb([g[2] for g in groups[s]])
        tops.append(top)
    root, upper = climb(tops)
    out = []
    for s, top, over in zip(names, tops, upper):
        for (_, _, own, r), path in zip(groups[s], paths[s]):
            low = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            h = leaf(r, low) if chosen else own
            for a, b in path + over:
                h = H(a, h, b)
            out.append((r["doc_id"], own, top, root, H(*[a + b for a, b in path + over]), h, h == root))
    return out


def query(docs):
    return merkle.verify(merkle.build(docs, merkle.tampered()))


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    a, b = merkle.op11_merkle(spark, SF).toPandas(), con.execute(merkle.SQL["op11_merkle"]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns) and sorted(map(str, a[c].values.tolist())) == sorted(map(str, b[c].values.tolist()))


@pytest.mark.parametrize("size", [1, 17, 5000])
def test_plain_python(spark, size):
    """Up to four levels; one hot source, sources of one row, null source, null fields, repeated rows, clashing columns."""
    rows = [{"doc_id": i, "text": f"Text É {i}", "lang": "en", "source": "hot", "n_chars": i} for i in range(size)]
    rows += [{"doc_id": i, "text": t, "lang": None, "source": s, "n_chars": None} for i, t, s in [(5, None, None), (None, "A", None), (None, "A", None), (7, "", "é"), (7, "", "é"), (7, "Z" * 100_000, "z"), (8, "x", "")]]
    rows += [{"doc_id": i, "text": "One", "lang": "en", "source": f"s{i}", "n_chars": 3} for i in range(40)]
    full = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "t", 1, 2, "d", "a", 3, 4, "p", 5) for r in rows]
    got = [tuple(r) for r in query(spark.createDataFrame(full, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_empty(spark):
    assert query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampering_shows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = query(docs).collect()
    assert {r.verified for r in rows} == {True, False}
    assert len({r.root for r in rows}) == 1 and all((r.folded_root == r.root) == r.verified for r in rows)
