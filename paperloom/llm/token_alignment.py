"""Alignment of two tokenizers over a corpus, in Arrow.

A task cuts its documents into chunks of about 4 MB of text. Per chunk, the ids of both tokenizers are list
columns: flattened, with parent indices telling the document, the cumulative sum of token lengths less the sum at
the document's start is the byte where a token ends. Two Acero tables meet in a hash join on (document, end); what
is joined are the links. Table.group_by counts id pairs within the chunk, and Spark merges these partial counts.

What the corpus says of a pair goes back to each chunk that holds it, one row for each of its distinct pairs, so a
pair that is everywhere costs a row a chunk, not a row a link. The links themselves wait in the chunk's row as
compressed indices into its pairs; texts are read and encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table
from paperloom.llm.packing import Encoder

PIECES = "piece_bpe_32k.model"
#: Bytes of text of a chunk, and texts encoded at once; a longer text is a chunk of its own.
CHUNK, AT_ONCE = 4_000_000, 128

CHUNK_SCHEMA = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, links binary, pairs array<long>, counts array<long>"
DOC_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {} string"


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Tokenizers:
    """Both tokenizers; for each id its bytes, and its decimal form with each separator that can follow it."""

    def __init__(self, path_a: str | None, path_b: str | None):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b or public_tokenizers.path(PIECES))
        known = byte_of_char()
        vocabulary = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = pa.array([bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in vocabulary], pa.large_binary())
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces], pa.large_binary())
        decimal = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.decimal = pa.array(decimal, pa.large_string())

    def encode(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Ids of both for each text."""
        parts: tuple[list, list] = ([], [])
        for at in range(0, len(texts), AT_ONCE):
            part = texts[at : at + AT_ONCE]
            parts[0].extend(x[:-1].astype(np.int32) for x in self.a.ids([" " + t for t in part]))
            parts[1].extend(np.array(x, np.int32) for x in self.b.encode(part, num_threads=1))
        return _lists(parts[0]), _lists(parts[1])


@cache
def tokenizers(path_a: str | None, path_b: str | None) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _lists(arrays: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
    return pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]), pa.int32()))


def _joined(ids: pa.LargeListArray, table: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens, and where those of each list begin and end."""
    taken = table.take(pc.list_flatten(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)
    return memoryview(taken.buffers()[2] or b"").cast("B"), at[ids.offsets.to_numpy()]


def _ends(ids: pa.LargeListArray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flattened ids, and a key (document, byte where the token ends) of each."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).to_numpy()
    sums = np.concatenate([[0], pc.cumulative_sum(pc.binary_length(table).take(flat).cast(pa.int64())).to_numpy()])
    return flat.to_numpy(), (sums[1:] - sums[ids.offsets.to_numpy()][parent]) | parent.astype(np.int64) << 40


def align(texts: list[str], both: Tokenizers, with_groups: bool = False) -> dict:
    """The columns of a chunk's row but doc_id: lists over the texts, links, pairs (A id << 32 | B id) and their counts."""
    a, b = both.encode(texts)
    whole = b"".join(" ".encode() + t.encode() for t in texts)
    starts = [0, *accumulate(len(t.encode()) + 1 for t in texts)]
    (a_data, a_at), (b_data, b_at) = _joined(a, both.a_bytes), _joined(b, both.b_bytes)
    good = [bool(t) and (w := whole[s:e]) == a_data[i:j] and w == b_data[k:m] for t, s, e, i, j, k, m in zip(texts, starts, starts[1:], a_at.tolist(), a_at[1:].tolist(), b_at.tolist(), b_at[1:].tolist())]
    del a_data, b_data, whole
    if not all(good):  # texts that one of them changes have no tokens
        a, b = (_lists([x.values.to_numpy() if g else np.empty(0, np.int32) for g, x in zip(good, ids)]) for ids in (a, b))
    (a_ids, a_key), (b_ids, b_key) = _ends(a, both.a_bytes), _ends(b, both.b_bytes)
    tables = [pa.table({"end": key, f"{name}_row": np.arange(len(key), dtype=np.int32)}) for name, key in (("a", a_key), ("b", b_key))]
    met = tables[0].join(tables[1], "end", join_type="inner", use_threads=False)
    a_hit, b_hit = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_hit[met["a_row"].to_numpy()] = True
    b_hit[met["b_row"].to_numpy()] = True
    del met, tables, a_key, b_key
    a_row, b_row = np.flatnonzero(a_hit), np.flatnonzero(b_hit)  # every token has an end of its own, so links are in order in both
    pairs = pc.dictionary_encode(pa.array(a_ids[a_row].astype(np.int64) << 32 | b_ids[b_row]))
    counted = pa.table({"pair": pairs.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    counts = np.zeros(len(pairs.dictionary), np.int64)
    counts[counted["pair"].to_numpy()] = counted["count_all"].to_numpy()
    # A's tokens of a group, then B's: each token's place is its own number and that of the others' tokens before it
    before = np.concatenate([[0], b_row + 1])
    codes = np.empty(len(a_ids) + len(b_ids), np.int32)
    codes[np.arange(len(a_ids)) + before[np.cumsum(a_hit) - a_hit]] = 2 * a_ids + a_hit
    codes[np.arange(len(b_ids)) + (a_row + 1)[np.cumsum(b_hit) - b_hit] if len(b_ids) else slice(0)] = 2 * (len(both.a_bytes) + b_ids) + b_hit
    text = both.decimal.take(pa.array(codes))
    offsets, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2] or b"").cast("B")
    a_off, b_off = a.offsets.to_numpy(), b.offsets.to_numpy()
    at = offsets[a_off + b_off].tolist()
    groups = [data[s : e - 1] if e > s else None for s, e in zip(at, at[1:])]
    hits = np.concatenate([[0], np.cumsum(a_hit)])[a_off]
    return {
        "n_a": np.diff(a_off),
        "n_b": np.diff(b_off),
        "n_groups": np.diff(hits),
        "groups": ["" if g is None else bytes(g).decode() if with_groups else hashlib.sha256(g).hexdigest() for g in groups],
        "links": zstandard.compress(pairs.indices.to_numpy().astype("<u2" if len(counts) <= 1 << 16 else "<u4").tobytes(), 1),
        "pairs": pairs.dictionary,
        "counts": counts,
    }


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str | None, path_b: str | None, with_groups: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"chunk": pa.int64(), **{c: pa.list_(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")}, "groups": pa.list_(pa.string()), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            part = batch.slice(at, stop - at)
            row = align([t or "" for t in part.column(1).to_pylist()], tokenizers(path_a, path_b), with_groups)
            row |= {"chunk": chunk, "doc_id": part.column(0)}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in kinds.items()], list(kinds))
            chunk, at = chunk + 1, stop
            del row, part
            pa.default_memory_pool().release_unused()


def _scored(chunk: pa.Table, said: pa.Table) -> pa.Table:
    """One row a document of one chunk, from its row and what the corpus says of its pairs (place, links, best)."""
    row = {c: chunk.column(c)[0] for c in chunk.column_names}
    raw = zstandard.decompress(row["links"].as_py())
    n = row["n_groups"].values.to_numpy()
    total, best = np.zeros(said.num_rows, np.int64), np.zeros(said.num_rows, bool)
    place = said["place"].to_numpy()
    total[place], best[place] = said["links"].to_numpy(), said["best"].to_numpy(zero_copy_only=False)
    links = np.frombuffer(raw, "<u2" if said.num_rows <= 1 << 16 else "<u4")
    at = np.concatenate([[0], np.cumsum(n)])
    sums, bests = (np.concatenate([[0], np.cumsum(x[links])])[at] for x in (total, best))
    columns = [row["doc_id"].values, row["n_a"].values, row["n_b"].values, n, n, np.diff(bests), np.diff(sums), row["groups"].values]
    return pa.table({k: pa.array(v) for k, v in zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"), columns)})


class Alignment:
    """Both tokenizers over docs (doc_id, text); path_a a tokenizers file of a byte-level vocabulary, path_b a sentencepiece model.

    Texts null or empty, and those that an encoder changes (a literal U+2581, say), have no tokens: zeros and ''. Repeated rows
    and null doc_ids are documents like any other, each counted. No rows give no rows; other columns are not read.
    """

    def __init__(self, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False):
        plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        chunks = plain.mapInArrow(partial(_chunks, path_a=path_a, path_b=path_b, with_groups=with_groups), CHUNK_SCHEMA)
        self.chunks = shared_table(chunks, "chunks")
        pairs = self.chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
        self._placed = pairs.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count"))
        summed = self._placed.groupBy("pair").agg(F.sum("count").alias("links"))
        of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # as many rows as A has ids at most
        self._summed = shared_table(summed.withColumn("best", F.col("links") == F.max("links").over(of_b)), "pairs")
        self.with_groups = with_groups

    def pairs(self) -> DataFrame:
        """a_id, b_id, links over all documents, and best: no A id has more links with this B id."""
        return self._summed.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "links", "best")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256, or the groups themselves if with_groups."""
        said = self._placed.join(self._summed, "pair").select(F.col("chunk").alias("of"), F.col("place").cast("long"), "links", "best")
        kept = self.chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups", "links")
        out = kept.groupBy("chunk").cogroup(said.groupBy("of")).applyInArrow(_scored, DOC_SCHEMA.format("groups"))
        return out if self.with_groups else out.withColumnRenamed("groups", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(documents(spark, sf_dir)).documents()


SQL: dict[str, str] = {}
QUERIES = {"op13_token_alignment": op13_token_alignment}
