"""Packing documents into training sequences: shortest-pack-first over the length histogram.

Token runs are cut into pieces of at most the sequence length. The histogram of piece lengths, which has
no more rows than that length, is packed on the driver: lengths from the longest, each into the shortest
pack that still has room, else into a new one. Packs of one pattern are a range of sequence numbers with a
count, so the work does not grow with the number of documents. The resulting placements are joined back to
the pieces by length and rank.

Ids are those that tokenizers gives for the byte_bpe_50k vocabulary. No token of it runs from a word over the white
space or the sign after it, so a text's ids are those of its chunks, white space with the word behind it and signs, one after the other.
Chunks are given to tokenizers once and remembered; a test holds the ids against those of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, running_total, shared_table, shuffled

LENGTH, END, MARK, VOCABULARY = 1024, 0, "<|endoftext|>", "byte_bpe_50k.json"
#: Chunks of at most so many characters are remembered, and so many of them.
SHORT, MOST = 40, 170_000
#: White space with the letters and digits behind it up to a sign, where the vocabulary's rule always ends a word; else up to white space.
CHUNK = re.compile(r"[ \t\n\r]*+[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]++(?=[!-/:-@\[-`{-~])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Other white space, or what may count as such: texts with it are not cut.
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028-\u202f\u205f\u3000\ufeff]")


class Encoder:
    """Ids of whole texts by a tokenizers file; path defaults to the installed public vocabulary."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"  # of the ids that are remembered
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # with a space
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks as little-endian numbers. Words behind one space go as one text, parted again where tokens open with a space."""
        words = [c for c in chunks if c[0] == " " and c[1:2] not in (" ", "\t", "\n", "\r", "")]
        rest = [*chunks.difference(words)]
        found = {c: np.array(ids, self.kind).tobytes() for c, ids in zip(rest, self.whole(rest))}
        if words:
            ids = np.array(self.whole(["".join(words)])[0], self.kind)
            line = ids.tobytes()
            starts = [*(ids.itemsize * np.flatnonzero(self.opens[ids])).tolist(), len(line)]
            found.update(zip(words, map(line.__getitem__, map(slice, starts, starts[1:])), strict=True))
        return found

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Little-endian ids of each text, with the end id."""
        plain = [not (MARK in t or RARE.search(t)) for t in texts]
        others = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        cut = [CHUNK.findall(t) if p else [] for t, p in zip(texts, plain)]
        held = [[*map(self.known.get, chunks)] for chunks in cut]
        gaps = [[i for i, x in enumerate(line) if x is None] for line in held]
        found = self.learn({chunks[i] for chunks, gap in zip(cut, gaps) for i in gap})
        self.known |= islice(((c, x) for c, x in found.items() if len(c) <= SHORT), MOST - len(self.known))
        end = np.array([END], self.kind).tobytes()
        for p, chunks, line, gap in zip(plain, cut, held, gaps):
            if not p:
                yield np.array([*next(others), END], "<u4")
                continue
            for i in gap:
                line[i] = found[chunks[i]]
            yield np.frombuffer(b"".join(line) + end, self.kind).astype("<u4")


@cache
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, path: str | None, checked: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32" if checked else "ids"]
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part, rows = batch.slice(at, 128), []
            texts = [t or "" for t in part.column(1).to_pylist()]
            # the encoder comes first: it puts its memory in order after the last text
            for ids, doc_id in zip(encoder(path).ids(texts), part.column(0).to_pylist()):
                rows += [(doc_id, s, len(x), len(ids), crc32(x) if checked else x.tobytes()) for s in range(0, len(ids), length) for x in (ids[s : s + length],)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if checked else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        pa.default_memory_pool().release_unused()


def token_pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, checked: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian 32-bit words) of every piece of every document; ids_crc32 for ids if checked."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    last = "ids_crc32 long" if checked else "ids binary"
    return plain.mapInArrow(partial(_pieces, length=length, path=path, checked=checked), f"doc_id long, start long, length long, doc_tokens long, {last}")


def plan_packs(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, end rank, pieces a pack, first sequence, offset) of a histogram of piece lengths.

    There are at most length * length / 2 of them whatever the counts, as packs of one pattern move together.
    """
    packs: dict[int, list[tuple[int, int]]] = {}
    fills: list[int] = []
    opened, placed = 0, []
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            fills = sorted(f for f, ranges in packs.items() if ranges and f + size <= length)
            if not fills:
                each = min(length // size, left) if size * 2 <= length else 1
                each = 1 if each == 0 else each
                count = left // each
                packs.setdefault(0, []).append((opened, count))
                opened += count
                fills = [0]
            fill = fills[0]
            reach = fills[1] if len(fills) > 1 else length
            first, count = packs[fill].pop()
            each = max(1, min((length - fill) // size, -(-(reach - fill) // size)))
            if left < count:
                each, used = 1, left
            else:
                each, used = min(each, left // count), count
            placed.append((size, rank, rank + used * each, each, first, fill))
            packs.setdefault(fill + size * each, []).append((first, used))
            if used < count:
                packs[fill].append((first + used, count - used))
            rank += used * each
            left -= used * each
    return placed


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length); sequences have no gaps and hold length tokens at most.

    pieces must give the same rows whenever it is read, as a written table does.
    """
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}
    plan = pieces.sparkSession.createDataFrame(plan_packs(histogram, length) or [(0, 0, 0, 1, 0, 0)], "p_length long, p_from long, p_to long, p_each long, p_first long, p_offset long")
    marked = pieces.withColumn("pos", shuffled(F.col("doc_id"), F.col("start"))).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(marked, ["length"], ["pos", "doc_id", "start"], "one", "nth", sum(histogram.values()))
    fits = (F.col("length") == F.col("p_length")) & (F.col("nth") > F.col("p_from")) & (F.col("nth") <= F.col("p_to"))
    nth = F.col("nth") - 1 - F.col("p_from")
    put = ranked.join(F.broadcast(plan), fits)
    put = put.withColumn("sequence_id", F.col("p_first") + F.floor(nth / F.col("p_each")).cast("long")).withColumn("offset", F.col("p_offset") + nth % F.col("p_each") * F.col("length"))
    return put.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Long texts are cut at every length tokens; repeated rows and
    null doc_ids are documents like any other. No rows give no rows; other columns of docs are not read.
    """
    pieces = token_pieces(docs, length, path, checked=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return pack_pieces(shared_table(pieces, "pieces"), length)


def packed_sequences(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids in order, ids (little-endian 32-bit words), length."""
    pieces = pack_pieces(shared_table(token_pieces(docs, length, path), "pieces"), length)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    rows = pieces.groupBy("sequence_id").agg(held.alias("held"))
    ids = F.aggregate("held.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    total = F.aggregate("held.length", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sequence_id", F.col("held.doc_id").alias("doc_ids"), ids.alias("ids"), total.alias("length"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
QUERIES = {"op8_packing": op8_packing}
