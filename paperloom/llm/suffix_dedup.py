"""Removal of byte strings that occur more than once, by suffix sorting in external memory.

Shards. Of every window of 400 bytes the least hash of its 32-byte strings is the window's anchor, so equal windows have equal
anchors wherever they stand. Neighbouring windows with one anchor at one place make a segment. Anchors that occur once have no
repeated window; equal segments of one anchor are told by their digest and sorted once. The different segments
of an anchor go to one shard, where induced_sort sorts their suffixes with their common prefixes:
a window is repeated if a neighbour in that order shares 400 bytes with it. Queues and long arrays of that sort lie on disk.

An anchor with more than HOT different segments would make a shard too large for one task. Its windows are settled by
digests instead, exactly: in pieces of 24 windows at first, of which those whose common core occurs once can have no
repeated window, then one by one, counted before they are shuffled.

A text that occurs more than once is repeated as a whole; texts are handled once each, by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, shared_table, shuffle_width, split_join
from paperloom.llm.induced_sort import repeated

LENGTH, GRAM, HOT, PIECE = 400, 32, 4096, 24

MARKS = "doc_id long, text binary, n_bytes long, sha string, first boolean, lo array<int>, hi array<int>, anchor array<long>, digest array<long>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


#: A number for each byte.
BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(text: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each string of size bytes, a power of two, from those of its halves."""
    h, step = BYTES[text], 1
    while step < size:
        h = _mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h


def _places(h: np.ndarray) -> np.ndarray:
    """Numbers whose order is that of the upper half of h; of equal ones the one further right is less. Their lower half tells the place."""
    return (h & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and the window after the last of each run of windows with one anchor at one place."""
    h, span = gram_hashes(text), length - GRAM + 1
    n = len(text) - length + 1
    blocks = np.append(_places(h), np.full(-len(h) % span, ~np.uint64(0))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[span - 1 :][:n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(ahead, behind)
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    place = (np.uint64(0xFFFFFFFF) - (least[cut] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return h[place].view(np.int64), cut, np.append(cut[1:], n)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _marks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row a document; segments only with the first of equal texts in the task."""
    from xxhash import xxh3_64_intdigest

    seen: set[bytes] = set()
    names, kinds = zip(*[(f.name, f.type) for f in pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("first", pa.bool_()), *[(c, pa.list_(pa.int32())) for c in ("lo", "hi")], *[(c, pa.list_(pa.int64())) for c in ("anchor", "digest")]])])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or b""
                sha = hashlib.sha256(text)
                key = sha.digest()[:16]
                first = key not in seen
                seen.add(key)
                row = (doc_id, key, len(text), sha.hexdigest(), first, None, None, None, None)
                if first and len(text) >= length:
                    anchor, lo, hi = anchors(np.frombuffer(text, np.uint8), length)
                    view = memoryview(text)
                    row = *row[:5], lo, hi, anchor, [_signed(xxh3_64_intdigest(view[a : b + length - 1])) for a, b in zip(lo.tolist(), hi.tolist())]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts in the task the first, with the head of its SHA-256."""
    seen: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for text in batch.column(0).slice(at, 256).to_pylist():
                key = hashlib.sha256(text).digest()[:16]
                if key not in seen:
                    seen.add(key)
                    rows.append((key, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["text", "body"])


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the segments of one shard, as ranges: anchor, digest, first window, window after the last."""
    import tempfile

    anchor, digest, sizes = [], [], []
    with tempfile.TemporaryFile() as file:  # has no name and ends with the task; nobody else reads it
        for batch in batches:
            anchor.append(batch.column(0).to_numpy())
            digest.append(batch.column(1).to_numpy())
            for piece in batch.column(2):
                file.write(piece.as_buffer())
                file.write(b"\0")
                sizes.append(len(piece.as_buffer()) + 1)
        if not sizes:
            return
        file.flush()
        text = np.memmap(file, np.uint8, "r")
    ends = np.cumsum(sizes) - 1
    hits = repeated(text, ends, length)
    starts = np.append(0, ends[:-1] + 1)
    opens = np.flatnonzero(np.append(True, np.diff(hits) > 1)) if len(hits) else np.empty(0, np.int64)
    lo, hi = hits[opens], np.append(hits[opens[1:] - 1], hits[-1:]) + 1
    which = np.searchsorted(ends, lo)
    columns = [np.concatenate(anchor)[which], np.concatenate(digest)[which], (lo - starts[which]).astype(np.int32), (hi - starts[which]).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "digest", "lo", "hi"])


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows by their distance from the anchor, PIECE distances at a time: anchor, digest, first window, core, digest of each window.

    The core is what all windows at these distances hold, so equal windows have one core wherever their segments begin and end.
    """
    from xxhash import xxh3_64_intdigest as digest_of

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for anchor, digest, piece in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                view, windows = memoryview(piece), len(piece) - length + 1
                place = int(np.argmin(_places(gram_hashes(np.frombuffer(piece, np.uint8)))[: length - GRAM + 1]))  # that of all windows
                cuts = [0, *range(place % PIECE + 1, windows, PIECE), windows]
                for lo, hi in zip(cuts, cuts[1:]):
                    start = place - (place - lo) // PIECE * PIECE
                    core = digest_of(view[start : start - PIECE + 1 + length])
                    rows.append((anchor, digest, lo, _signed(core), [_signed(digest_of(view[i : i + length], 1)) for i in range(lo, hi)]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "digest", "lo", "core", "windows"])


def _by_digests(segments: DataFrame, length: int) -> DataFrame:
    """As _shard gives, for anchors that have very many segments: anchor, digest, lo, hi of each repeated window."""
    pieces = shared_table(segments.mapInArrow(partial(_pieces, length=length), "anchor long, digest long, lo int, core long, windows array<long>"), "pieces")
    cores = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    each = split_join(pieces, cores, "core").select("anchor", "digest", "lo", "core", F.posexplode("windows").alias("nth", "window"))
    each = shared_table(each.select("anchor", "digest", (F.col("lo") + F.col("nth")).alias("lo"), F.struct("core", "window").alias("pair")), "windows")
    twice = each.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair")
    return split_join(each, twice, "pair").select("anchor", "digest", "lo", (F.col("lo") + 1).alias("hi"))


def _segments(bodies: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """anchor, digest, bytes of the segments of keys (anchor, digest, at: text, lo, hi)."""
    wanted = keys.groupBy("at.text").agg(F.collect_list(F.struct("anchor", "digest", "at.lo", "at.hi")).alias("wanted"))
    rows = bodies.join(wanted, "text").select("body", F.explode("wanted").alias("w"))
    return rows.select("w.anchor", "w.digest", F.expr(f"substring(body, w.lo + 1, w.hi - w.lo + {length - 1})").alias("bytes"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text (text, body, ranges of bytes in any order): text, spans, digest of what is left."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for text, body, los, his in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                order = np.argsort(los)
                lo, hi = np.array(los)[order], np.maximum.accumulate(np.array(his)[order])
                opens = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                lo, hi = lo[opens].tolist(), np.append(hi[opens[1:] - 1], hi[-1]).tolist()
                kept = hashlib.sha256()
                for a, b in zip([0, *hi], [*lo, len(body)]):
                    kept.update(memoryview(body)[a:b])
                rows.append((text, [{"start": a, "end": b} for a, b in zip(lo, hi)], kept.hexdigest()))
            if rows:
                kinds = (pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["text", "spans", "kept"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, spans (array of start, end), kept_sha256.

    Removed is each byte in a string of length bytes that starts at another place too, in this document or another one; spans
    are the longest runs of removed bytes. A null text is empty; shorter texts lose nothing. Repeated rows repeat each other,
    so both lose all. A null doc_id is a document like any other. No rows give no rows; other columns are not read.
    length must be more than GRAM.
    """
    body = F.col("text").cast("string").cast("binary")
    marks = shared_table(docs.select(F.col("doc_id").cast("long"), body.alias("text")).mapInArrow(partial(_marks, length=length), MARKS), "marks")
    each = marks.where("first and lo is not null").select("text", F.explode(F.arrays_zip("lo", "hi", "anchor", "digest")).alias("s")).select("text", "s.*")
    known = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("several")).where("n > 1").drop("n")
    occurrences = shared_table(split_join(each, known, "anchor"), "occurrences")
    several = occurrences.where("several").withColumn("pair", F.struct("anchor", "digest"))
    keys = several.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text", "lo", "hi")).alias("at"))
    keys = shared_table(keys.select("pair.*", "pair", "n", "at"), "keys")
    large = keys.groupBy("anchor").agg((F.count(F.lit(1)) > hot).alias("large"))
    keys = shared_table(split_join(keys, large, "anchor"), "keys")
    texts = docs.select(body.alias("body")).where("body is not null").mapInArrow(_first_texts, "text binary, body binary")
    bodies = texts.join(occurrences.select("text").distinct(), "text", "left_semi").groupBy("text").agg(F.first("body").alias("body"))
    bodies = shared_table(bodies, "bodies")
    shards = _segments(bodies, keys.where("not large"), length).repartition(shuffle_width(docs.sparkSession), "anchor")
    found = shards.mapInArrow(partial(_shard, length=length), "anchor long, digest long, lo int, hi int")
    if not keys.where("large").isEmpty():
        found = found.unionByName(_by_digests(_segments(bodies, keys.where("large"), length), length))
    once = found.join(keys.where("n = 1").select("anchor", "digest", "at"), ["anchor", "digest"])
    once = once.select("at.text", (F.col("at.lo") + F.col("lo")).alias("lo"), (F.col("at.lo") + F.col("hi")).alias("hi"))
    whole = split_join(several, keys.where("n > 1").select("pair"), "pair").select("text", "lo", "hi")
    ranges = occurrences.where("not several").select("text", "lo", "hi").unionByName(whole).unionByName(once)
    ranges = ranges.groupBy("text").agg(F.collect_list("lo").alias("los"), F.collect_list(F.col("hi") + (length - 1)).alias("his"))
    cut = bodies.join(ranges, "text").select("text", "body", "los", "his").mapInArrow(_cut, "text binary, spans array<struct<start:long,end:long>>, kept string")
    copied = marks.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    per_text = shared_table(cut.join(copied, "text", "full"), "texts")
    rows = split_join(marks.drop("lo", "hi", "anchor", "digest"), per_text, "text", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<start:long,end:long>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    rows = rows.withColumn("spans", F.when(copy, all_of).otherwise(F.coalesce("spans", none)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    kept = F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept", "sha"))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", kept.alias("kept_sha256"))


def kept_bytes(body: F.Column, spans: F.Column) -> F.Column:
    """body, bytes, without spans, which ascend."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    starts = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.octet_length(body).cast("long")))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.substring(body, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    return F.aggregate(gaps, F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir)).drop("spans")


SQL: dict[str, str] = {}
QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
