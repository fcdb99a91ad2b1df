"""A Merkle manifest of a dataset: one tree for each source, and one over the roots of the sources.

A tree is built level by level. Within a window of consecutive nodes, lag and lead columns at the fixed offsets
1 to 15 hold a node's neighbours; its slot in the run of 16 and the run's length mask those of other runs, so what
is left are its siblings. The first child of each run hashes the run into the parent. A window spans a
block of 4,096 nodes, whole runs, so no task sees a source: one with a third of all rows is many blocks.

Going down again, each level's nodes join the path of their parent, a path being the siblings left and right of
every node up to the root. Paths join leaves after the leaves' own window, in the same partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import documents, ordered_totals, shared_table, split_join

FANOUT, BLOCK = 16, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: F.Column) -> F.Column:
    """`-` for null, else the value's UTF-8 byte count, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: F.Column | None = None) -> F.Column:
    """SHA-256 of a row's five fields; text, if given, stands for the column of that name."""
    values = [text if text is not None and name == "text" else F.col(name) for name in FIELDS]
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _with_siblings(nodes: DataFrame, *part: F.Column) -> DataFrame:
    """nodes (tree, idx, n, digest, ...) with left and right, the digests of the siblings before and after, in order."""
    slot = F.col("idx") % FANOUT
    run = F.least(F.lit(FANOUT), F.col("n") - F.col("idx") + slot)
    w = Window.partitionBy("tree", *part).orderBy("idx")
    near = {f"lag{j}": F.lag("digest", j).over(w) for j in range(1, FANOUT)} | {f"lead{j}": F.lead("digest", j).over(w) for j in range(1, FANOUT)}
    left = F.concat(*[F.when(slot >= j, F.col(f"lag{j}")).otherwise("") for j in range(FANOUT - 1, 0, -1)])
    right = F.concat(*[F.when(slot + j < run, F.col(f"lead{j}")).otherwise("") for j in range(1, FANOUT)])
    return nodes.withColumns(near).withColumns({"left": left, "right": right}).drop(*near)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that have several nodes; digests of first children and all behind them, hashed."""
    firsts = _with_siblings(nodes.where("n > 1"), F.floor(F.col("idx") / BLOCK)).where(F.col("idx") % FANOUT == 0)
    n = F.ceil(F.col("n") / FANOUT).cast("long")
    return firsts.select("tree", F.floor(F.col("idx") / FANOUT).alias("idx"), n.alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """nodes and the levels above it, as written tables; a tree's last node has n = 1 and is in no further level."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(shared_table(_parents(levels[-1].select("tree", "idx", "n", "digest")), "level"))
        most = -(-most // FANOUT)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    tops = [level.where("n = 1").select("tree", "digest") for level in levels]
    for more in tops[1:]:
        tops[0] = tops[0].unionByName(more)
    return tops[0]


def _paths(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """nodes with path, siblings from their own level up, and what tops (tree, path, ...) says of their tree.

    above: the paths of the next level. Nodes without siblings, alone in their tree, take the path of tops.
    """
    alone = nodes.where("n = 1").join(tops, "tree")
    if above is None:
        return alone
    many = _with_siblings(nodes.where("n > 1").withColumn("up", F.floor(F.col("idx") / FANOUT)), F.col("up"))
    above = above.drop("n", "digest").withColumnsRenamed({"idx": "up", "path": "rest"})
    own = F.array(F.struct("left", "right"))
    many = many.join(above, ["tree", "up"]).withColumn("path", F.concat(own, "rest"))
    return many.select(*alone.columns).unionByName(alone)


def _all_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of levels[0]; those of the levels above it are written on the way down."""
    above = None
    for level in reversed(levels[1:]):
        above = shared_table(_paths(level, above, tops), "paths")
    return _paths(levels[0], above, tops)


@dataclass(frozen=True)
class Manifest:
    """leaves: doc_id, leaf, altered (null: as leaf), tree (source), idx; and their levels. sources: tree, subroot, root, path."""

    levels: list[DataFrame]
    sources: DataFrame

    def proofs(self) -> DataFrame:
        """doc_id, leaf, altered, subroot, root, path: array of (left, right), the siblings' digests at each level up to the root."""
        return _all_paths(self.levels, self.sources).select("doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")


def build(docs: DataFrame, altered: F.Column | None = None) -> Manifest:
    """The trees of docs, whose columns are those of FIELDS; altered, a digest, is carried along for verify().

    Leaves of a source ascend by doc_id, null first; rows alike in doc_id by digest. A null source is a source of its own and the first.
    Repeated rows are leaves of their own. Other columns are not read. No rows give no leaves, no sources and no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # keeps the order, null first
    rows = docs.select(F.col("doc_id").cast("long"), leaf_digest().alias("digest"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"), tree.alias("tree"), F.monotonically_increasing_id().alias("row"))
    rows = shared_table(rows.withColumn("one", F.lit(1).cast("long")), "leaves")
    counts = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("one").alias("one"))
    trees = shared_table(ordered_totals(shared_table(counts, "trees"), ["tree"], {"n": "end", "one": "place"}), "trees")
    ranked = shared_table(ordered_totals(rows, ["tree", "doc_id", "digest", "row"], {"one": "rank"}), "ranked")
    placed = split_join(ranked, trees.select("tree", "n", (F.col("end") - F.col("n")).alias("before")), "tree")
    placed = placed.select("tree", (F.col("rank") - 1 - F.col("before")).alias("idx"), "n", "digest", "doc_id", "altered")
    levels = _levels(shared_table(placed, "placed"))
    n = trees.count()
    subroots = _tops(levels).join(trees.select("tree", "place"), "tree")
    over = subroots.select(F.lit("").alias("tree"), (F.col("place") - 1).alias("idx"), F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("source"))
    upper = _levels(shared_table(over, "subroots"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = _tops(upper).select("tree", F.col("digest").alias("root"), none.alias("path"))
    sources = _all_paths(upper, root).select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return Manifest(levels, shared_table(sources, "sources"))


def folded(leaf: F.Column, path: F.Column) -> F.Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, at: F.sha2(F.concat(at["left"], h, at["right"]), 256))


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings, level by level, left to right), folded_root (from altered, else leaf), verified."""
    rows = manifest.proofs()
    siblings = F.aggregate("path", F.lit(""), lambda s, at: F.concat(s, at["left"], at["right"]))
    rows = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered() -> F.Column:
    """The leaf of a row whose text's A-Z were lower-cased, where 5 divides the CRC-32 of the decimal doc_id; else, and for a null doc_id, null."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(F.translate(F.col("text"), capitals, capitals.lower())))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(build(documents(spark, sf_dir), tampered()))


def _sql(depth: int = 6, upper: int = 3) -> str:
    """depth: levels of a source, for 16 ** depth rows; upper: levels over the sources."""
    parts = {c: f"coalesce(strlen({v}) || ':' || {v}, '-')" for c, v in {**{c: f"{c}::VARCHAR" for c in FIELDS}, "low": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}.items()}
    head = " || ".join(parts[c] for c in FIELDS[:-1])
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(t) + 1), lambda k: ascii(substr(t, k, 1))::BIGINT)), lambda c, b: {step}), 4294967295)"
    ctes = [
        f"leaves AS (SELECT doc_id, source, sha256({head} || {parts['text']}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {parts['low']}) END AS bad FROM (SELECT *, doc_id::VARCHAR AS t FROM documents))",
        "s AS (SELECT doc_id, leaf, bad, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "a0 AS (SELECT tree, pos AS i, n, leaf AS d FROM s)",
    ]

    def level(a: str, k: int) -> None:
        run = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        ctes.append(f"{a}s{k} AS (SELECT *, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{k})")
        ctes.append(f"{a}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {a}{k} GROUP BY tree, i // 16, n)")

    for k in range(depth):
        level("a", k)
    ctes.append(f"u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d, tree AS source FROM a{depth})")
    for k in range(upper):
        level("u", k)
    joins = f" JOIN a{depth} top ON top.tree = s.tree JOIN u0 ON u0.source = s.tree CROSS JOIN u{upper} root"
    rows, steps, at = ["s.doc_id", "s.leaf", "top.d AS subroot", "root.d AS root", "coalesce(s.bad, s.leaf) AS h0", "'' AS p0"], [], 0
    for a, size, place in (("a", depth, "s.pos"), ("u", upper, "u0.i")):
        for k in range(size):
            own = f"{a}s{k}"
            joins += f" JOIN {own} ON {own}.i = {place} // {16**k}" + (f" AND {own}.tree = s.tree" if a == "a" else "")
            rows += [f"{own}.n AS n{at}", f"{own}.l AS l{at}", f"{own}.r AS r{at}"]
            steps.append(f"(SELECT *, CASE WHEN n{at} > 1 THEN sha256(l{at} || h{at} || r{at}) ELSE h{at} END AS h{at + 1}, p{at} || l{at} || r{at} AS p{at + 1} FROM ")
            at += 1
    ctes.append(f"rows AS (SELECT {', '.join(rows)} FROM s{joins})")
    folds = "".join(reversed(steps)) + "rows" + ")" * len(steps)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(p{at}) AS proof_sha256, h{at} AS folded_root, h{at} = root AS verified FROM {folds}"


SQL = {"op11_merkle": _sql()}
QUERIES = {"op11_merkle": op11_merkle}
