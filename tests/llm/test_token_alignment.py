"""Token alignment against the two tokenizers and plain Python."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from paperloom.llm import token_alignment

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "   ", "a", "Hello world", "Hello world", "<|endoftext|> in text <s> </s> <unk>", "▁literal", "tab\there\nline\r\n", "é ü 漢字 \U0001f600", " 　x", "ﬁ Å", "z" * 3000, "word " * 2000, "\x00\x01 nul", "  two  spaces  "]


def plain(rows):
    """doc_id and the seven columns of each (doc_id, text)."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out, corpus = [], Counter()
    chars = token_alignment.byte_of_char()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a = ids_b = bytes_a = bytes_b = []
        ends = []
        for parts in (bytes_a, bytes_b):
            at, where = 0, []
            for p in parts:
                at += len(p)
                where.append(at)
            ends.append(where)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j, links = [], 0, 0, []
        for end in common:
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        corpus.update(links)
        out.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, len(x), len(y), len(k), len(k), sum(corpus[p] == best[p[1]] for p in k), sum(corpus[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if x else "", g) for d, x, y, k, g in out]


@pytest.mark.parametrize("chunk", [200, 4_000_000])
def test_odd_texts(spark, chunk):
    """Null, empty, special strings, changed texts, repeated rows, clashing columns; one chunk or a chunk for nearly every text."""
    rows = [(None if i == 3 else i % 12, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, chunk long, pair long").coalesce(1)
    if chunk < 4_000_000:
        docs = docs.repartition(len(rows))
    both = token_alignment.Alignment(docs)
    want = plain(rows)
    assert sorted(map(str, map(tuple, both.documents().collect()))) == sorted(str(r[:8]) for r in want)
    assert [r for r in want if r[1] == 0 and rows[want.index(r)][1]] != []  # some text is changed by an encoder
    spelt = token_alignment.Alignment(docs, with_groups=True).documents().collect()
    assert sorted(r.groups for r in spelt) == sorted(r[8] for r in want)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))[:60]
    part = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    both = token_alignment.Alignment(part)
    want = plain(rows)
    assert sorted(map(str, map(tuple, both.documents().collect()))) == sorted(str(r[:8]) for r in want)
    assert both.pairs().agg({"links": "sum"}).first()[0] == sum(r[4] for r in want)


def test_empty(spark):
    assert token_alignment.Alignment(spark.createDataFrame([], "doc_id long, text string")).documents().count() == 0
