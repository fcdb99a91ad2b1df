"""SimHash near-duplicates, found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into six blocks of 11, 11, 11, 11, 10 and 10 bits. A key is made of two blocks
taken as they are and a segment of two further blocks, decoded to the index of a nearby codeword of the
(23, 12) Golay code: all codewords within distance four, 5.3 of them on average, give a key each. Two
segments at distance two or less share one of these: some word lies at most one bit from both, its nearest
codeword at most three bits further. Two fingerprints that differ in at most four bits agree in at least
two blocks, and the segments in COVER, one for each pair of blocks, are such that for every spread of four
errors over the blocks some pair is free of errors while its segment has two at most (a test tries all
spreads). So every link shows in a key of 34 bits, about 80 keys a fingerprint, all through the code.

Only distinct fingerprints are joined. The members of a bucket are first linked to its least and greatest
member; after components of those links, only members of one bucket with different labels are compared
with each other, so that a large group of near copies never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import connected_components, documents, keep_rows, line_digest, shared_table, shuffle_width, split_join

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: The blocks of a key's segment, for each pair of blocks taken as they are.
COVER = {
    (0, 1): (4, 5), (0, 2): (3, 5), (0, 3): (1, 2), (0, 4): (1, 5), (0, 5): (3, 4),
    (1, 2): (3, 4), (1, 3): (2, 5), (1, 4): (2, 3), (1, 5): (3, 4), (2, 3): (0, 1),
    (2, 4): (0, 3), (2, 5): (1, 3), (3, 4): (0, 2), (3, 5): (0, 1), (4, 5): (1, 2),
}
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of the text's 4-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - SHINGLE]).tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ bits for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "line", "fp"])
        pa.default_memory_pool().release_unused()


@cache
def golay_errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words by halves, and for each syndrome its error patterns of weight 4 or less (-1: none)."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    low = np.array([syndrome(w) for w in range(1 << 12)])
    high = np.array([syndrome(w << 12) for w in range(1 << 11)])
    lists: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            lists[low[error & 0xFFF] ^ high[error >> 12]].append(error)
    table = np.full((1 << 11, max(map(len, lists))), -1, np.int64)
    for s, errors in enumerate(lists):
        table[s, : len(errors)] = errors
    return low, high, table


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and a mask of those that exist; each has 6 bits of kind and up to 34 of content."""
    blocks = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]
    low, high, errors = golay_errors()
    keys, real = [], []
    for kind, ((i, j), (a, b)) in enumerate(COVER.items()):
        segment = blocks[a] << 11 | blocks[b]
        near = errors[low[segment & 0xFFF] ^ high[segment >> 12]]
        index = (segment[:, None] ^ near) >> 11
        keys.append(kind << 34 | (blocks[i] << 23 | blocks[j] << 12)[:, None] | index)
        real.append(near >= 0)
    return np.concatenate(keys, axis=1), np.concatenate(real, axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.column(0).slice(at, 4096)
            keys, real = fuzzy_keys(part.to_numpy(zero_copy_only=False).view(np.uint64))
            offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[real]))], ["fp", "keys"])


def _near(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, label) of distinct fingerprints (fp): label is the same for two that are linked over any chain."""
    buckets = fps.repartition(shuffle_width(fps.sparkSession), "fp").mapInArrow(_keys, "fp long, keys array<long>")
    buckets = buckets.select("fp", F.explode("keys").alias("key"))
    ends = buckets.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    # Spark takes the 80 keys behind an explode for one, and would broadcast millions of ends as a small table
    members = shared_table(buckets.join(ends.hint("merge"), "key"), "buckets")
    to_ends = [members.where((F.col("fp") != F.col(end)) & _near("fp", end)).select(F.col("fp").alias("a"), F.col(end).alias("b")) for end in ("lo", "hi")]
    stars = connected_components(to_ends[0].union(to_ends[1])).withColumnRenamed("node", "fp")
    labelled = members.select("key", "fp").join(stars, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("label"))
    labelled = shared_table(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    left = labelled.join(mixed, "key", "left_semi")
    right = left.select("key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    pairs = left.join(right, "key").where(F.col("label") < F.col("label2")).where(_near("fp", "fp2"))
    merged = connected_components(pairs.select(F.col("label").alias("a"), F.col("label2").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("root").alias("top"))
    merged = shared_table(merged, "merged")
    labels = shared_table(fps.select("fp").join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")
    return split_join(labels, merged, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))


def _labelled(docs: DataFrame, line: F.Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line, fp) of every row, and (fp, label) of the distinct fingerprints."""
    marked = docs.select(F.col("doc_id").cast("long"), line.alias("line"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, line string, fp long")
    marked = shared_table(marked, "fingerprints")
    fps = shared_table(marked.select("fp").distinct(), "distinct")
    return marked, shared_table(fingerprint_components(fps), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other.
    A null doc_id takes part but is never a component_id unless nothing else is in its component. Repeated
    rows are all returned. No rows give no rows; other columns of docs are not read.
    """
    marked, labels = _labelled(docs, F.lit(""))
    docs_of = shared_table(labels.join(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")), "fp"), "least")
    least = shared_table(docs_of.groupBy("label").agg(F.min("doc").alias("component_id")), "least")
    components = shared_table(split_join(docs_of, least, "label").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return split_join(marked, components, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; all columns.

    That with the least doc_id stays, a null doc_id only where there is no other; of those alike in doc_id that with the least line_digest.
    """
    marked, labels = _labelled(docs, line_digest(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")).alias("first")
    best = marked.groupBy("fp").agg(first).join(labels, "fp").groupBy("label").agg(F.min("first").alias("first"))
    return keep_rows(docs, best.select("first.line"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op7_simhash_dedup": op7_simhash_dedup}
