"""A Merkle manifest of a dataset: content-addressed records of digests, proofs by descent from the root.

A leaf is the digest of a row.  The leaves of a part (a language, say) are ranked by key; runs of ``FAN`` consecutive
nodes become one node until one is left, the part's subroot, and the subroots, ranked by part, become the root likewise.

1. Row digests are computed where rows are read; only digests and keys move.  Ranges of (part, key, digest) are sorted in
   tasks, and ranks follow from the number of rows of each part in each range.
2. A tree is built in segments of up to ``SEGMENT`` nodes and ``LEVELS`` levels: one shuffle for ten levels of pairs.  The
   store holds one record for each segment's digest: the children under it, level by level downwards.  Equal digests have
   equal children, so equal segments are stored once.
3. A request is a part and a rank.  From the root downwards the record of a digest is looked up in the store by a join,
   the digits of the rank to base ``FAN`` select a child on every level, and the children not selected are collected;
   reversed and put before the path of the segment above, they are the path from leaf to root.  Requests that share a
   segment share its lookup: what descends is the set of their rank prefixes, until the last segment meets the requests.

No group holds more than ``SEGMENT`` rows.  The driver sees the root and counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, ranked_spans, settle

FAN, LEVELS = 2, 10
SEGMENT = FAN**LEVELS
#: Segments on a path at most: 1024^6 leaves are beyond any number of rows.
MOST_SEGMENTS = 6
PATH = "array<struct<before:string,after:string>>"
RECORD = "digest string, levels int, held int, children array<string>"


@dataclass
class Manifest:
    """``leaves``: (tree, n, rank, part, leaf, payload), ``store``: digest records, ``trees``: (tree, part, n, subroot, path to the root)."""

    leaves: DataFrame
    store: DataFrame
    trees: DataFrame
    root: str | None


def node(text: str) -> str:
    """H: lower-case hex of SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, at: F.sha2(F.concat(at["before"], digest, at["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """H of the siblings of a path, leaf to root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda at: F.concat(at["before"], at["after"]))).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def segment_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The levels over consecutive nodes, the given ones first."""
    out = [digests]
    for _ in range(levels):
        out.append([node("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def _pack(table: pa.Table) -> pa.Table:
    """The nodes of one segment -> its record, and its place among the nodes of the next level of segments."""
    table = table.combine_chunks().sort_by("rank")
    n = table["n"][0].as_py()
    levels = min(LEVELS, depth(n))
    tiers = segment_levels(table["digest"].to_pylist(), levels)
    row = {"tree": table["tree"][0].as_py(), "n": -(-n // FAN**levels), "rank": table["rank"][0].as_py() // SEGMENT, "digest": tiers[-1][0], "levels": levels, "held": len(tiers[0]), "children": [d for t in tiers[-2::-1] for d in t]}
    return pa.Table.from_pylist([row], schema=pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("levels", pa.int32()), ("held", pa.int32()), ("children", pa.list_(pa.string()))]))


def _build(nodes: DataFrame, most: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """(tree, n, rank, digest) -> records by level of segments, and (tree, digest) of every tree's root; ``most``: nodes of the largest tree."""
    keys = ["tree", "n", "rank", "digest"]
    records, roots = [], nodes.where("n = 1").select("tree", "digest")
    while most > 1:
        block = F.floor(F.col("rank") / SEGMENT)
        packed = nodes.where("n > 1").select(*keys).groupBy("tree", block.alias("block")).applyInArrow(_pack, f"tree long, n long, rank long, {RECORD}")
        nodes = settle(packed, f"{label}-{len(records)}")
        records.append(nodes.select("digest", "levels", "held", "children"))
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // SEGMENT)
    return records, roots


def _segments(n: Column) -> Column:
    """Segments between a root and its leaves."""
    return F.coalesce(*[F.when(n <= SEGMENT**k, F.lit(k)) for k in range(MOST_SEGMENTS)], F.lit(MOST_SEGMENTS))


def _descents(held: int, levels: int, children: list[str]) -> list[list[tuple[str, str]]]:
    """For each node at the foot of a segment, the unselected children left and right of its way down, lowest first."""
    sizes = [held]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // FAN))
    tiers, at = [], 0
    for size in sizes[-2::-1]:  # downwards
        tiers.append(children[at : at + size])
        at += size
    ways: list[list[tuple[str, str]]] = [[]]
    for tier in tiers:
        below = []
        for i in range(len(tier)):
            lo = i // FAN * FAN
            below.append([("".join(tier[lo:i]), "".join(tier[i + 1 : lo + FAN])), *ways[i // FAN]])
        ways = below
    return ways


def _paths(rows: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = [p for r in rows for p in r]
    parts = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], names=["before", "after"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


def _known(path: list[dict]) -> list[tuple[str, str]]:
    return [(p["before"], p["after"]) for p in path]


def _prefixes(batches):
    """Opened records -> one row for each child at the foot of the segment."""
    for batch in batches:
        for row in batch.to_pylist():
            ways = _descents(row["held"], row["levels"], row["children"])
            above = _known(row["path"])
            feet = row["children"][len(row["children"]) - row["held"] :]
            same = lambda v, kind, n=len(ways): pa.array([v] * n, kind)
            yield pa.RecordBatch.from_arrays(
                [same(row["tree"], pa.int64()), same(row["subroot"], pa.string()), pa.array([row["block"] * SEGMENT + i for i in range(len(ways))], pa.int64()), pa.array(feet, pa.string()), same(row["segments"] - 1, pa.int32()), _paths([w + above for w in ways])],
                names=["tree", "subroot", "block", "digest", "segments", "path"],
            )


def _answer(requests: pa.Table, record: pa.Table) -> pa.Table:
    """Requests for the leaves of one segment, and that segment's record with the path above it."""
    kept = requests.drop_columns(["block"]).combine_chunks()
    if record.num_rows != 1:  # no such leaf
        return kept.slice(0, 0).append_column("subroot", pa.array([], pa.string())).append_column("path", _paths([]))
    (top,) = record.to_pylist()
    ways = _descents(top["held"], top["levels"], top["children"]) if top["levels"] else [[]]
    above = _known(top["path"])
    at = [r % SEGMENT for r in kept["rank"].to_pylist()]
    found = [i for i, r in enumerate(at) if r < len(ways)]
    kept = kept.take(pa.array(found, pa.int64()))
    return kept.append_column("subroot", pa.array([top["subroot"]] * len(found), pa.string())).append_column("path", _paths([ways[at[i]] + above for i in found]))


def _descend(store: DataFrame, tops: DataFrame, requests: DataFrame, most: int, every: bool, label: str) -> DataFrame:
    """Requests (tree, rank, ...) with ``subroot`` and ``path``; ``tops``: (tree, n, subroot, path) of the trees, ``most``: leaves of the largest."""
    frontier = tops.select("tree", "subroot", F.lit(0).cast("long").alias("block"), F.col("subroot").alias("digest"), _segments(F.col("n")).cast("int").alias("segments"), "path")
    deepest = next((k for k in range(MOST_SEGMENTS) if most <= SEGMENT**k), MOST_SEGMENTS)
    for k in range(deepest, 1, -1):
        opened = frontier.where(F.col("segments") == k).join(store, "digest").mapInArrow(_prefixes, f"tree long, subroot string, block long, digest string, segments int, path {PATH}")
        if not every:
            asked = requests.select("tree", F.floor(F.col("rank") / SEGMENT ** (k - 1)).alias("block")).distinct()
            opened = opened.join(asked, ["tree", "block"], "left_semi").select(*frontier.columns)
        frontier = settle(frontier.where(F.col("segments") < k).unionByName(opened), f"{label}-{k}")
    heads = frontier.join(store, "digest", "left").select("tree", "block", "subroot", "path", F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("held", F.lit(1)).alias("held"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    asking = requests.withColumn("block", F.floor(F.col("rank") / SEGMENT))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return asking.groupBy("tree", "block").cogroup(heads.groupBy("tree", "block")).applyInArrow(_answer, f"{fields}, subroot string, path {PATH}")


def build_manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``rows`` (part string, key, leaf string, payload): trees, digest records and the root.

    Parts are ranked bytewise, a null part first; leaves by key, null first, then by digest.  Rows that repeat are leaves
    of their own and are ranked in any order, since nothing tells them apart.  An empty table has no root and no trees.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    placed, spans = ranked_spans(settle(tie, "merkle-leaves"), ["key", "leaf", "tie"], "merkle-order")
    own = settle(spans.groupBy("part").agg(F.sum("held").alias("n")), "merkle-parts")
    top_placed, top_spans = ranked_spans(own.select(F.lit("").alias("part"), F.col("part").alias("name"), "n"), ["name"], "merkle-part-order")
    trees = settle(numbered(top_placed, top_spans).select(F.col("rank").alias("tree"), F.col("name").alias("part"), "n"), "merkle-trees")
    count, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    few = trees.withColumnRenamed("part", "of_")
    spans = spans.join(F.broadcast(few) if count <= 10_000 else few, spans["part"].eqNullSafe(few["of_"])).drop("of_")
    leaves = settle(numbered(placed, settle(spans, "merkle-tree-spans"), "tree", "n").select("tree", "n", "rank", "part", "leaf", "payload"), "merkle-ranks")
    records, roots = _build(leaves.withColumnRenamed("leaf", "digest"), most or 0, "merkle-segments")
    roots = settle(roots.join(trees, "tree").select("tree", "part", "n", F.col("digest").alias("subroot")), "merkle-roots")
    crown = roots.select(F.lit(-1).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"))
    more, last = _build(crown, count, "merkle-crown")
    root = last.first()
    schema = rows.sparkSession.createDataFrame([], RECORD)
    store = schema
    for r in records + more:
        store = store.unionByName(r)
    store = settle(store.dropDuplicates(["digest"]), "merkle-store")
    start = roots.sparkSession.createDataFrame([(-1, count, root["digest"])] if root else [], "tree long, n long, subroot string").withColumn("path", F.array().cast(PATH))
    reached = _descend(store, start, roots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("rank"), "part", "n", F.col("subroot").alias("own")), count, True, "merkle-crown-paths")
    trees = settle(reached.select(F.col("rank").alias("tree"), "part", "n", F.col("own").alias("subroot"), "path"), "merkle-tops")
    return Manifest(leaves, store, trees, root["digest"] if root else None)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Paths of the requested leaves: ``requests`` (tree, rank, any other columns) with ``subroot`` and ``path``; all leaves where None.

    A path holds, from leaf to root, the digests left (``before``) and right (``after``) of the way.  Requests that repeat
    are answered one by one; those for a rank that doesn't exist, or with a null, have no row.
    """
    most = manifest.trees.agg(F.max("n")).first()[0] or 0
    asked = manifest.leaves.select("tree", "rank", "leaf", "payload") if requests is None else requests
    return _descend(manifest.store, manifest.trees, asked, most, requests is None, "merkle-paths")


def document_manifest(docs: DataFrame) -> tuple[Manifest, DataFrame]:
    """Manifest of ``documents`` by language and doc_id, and its audit against tampered rows.

    The audit has one row a document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).  Where 7 divides the
    unsigned crc32 of the decimal doc_id, the leaf is folded with 1 added to n_chars; a null n_chars or doc_id stays.
    Nulls in any column enter leaves as ``-``; empty and very long texts are hashed whole where they are read.  Repeated
    ids are ranked by leaf; rows repeated whole each have their own proof.  An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(fields)]
    tampered = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    rows = docs.select(F.col("lang").cast("string").alias("part"), F.col("doc_id").alias("key"), leaf_digest(*fields).alias("leaf"), F.struct("doc_id", F.when(tampered, leaf_digest(*forged)).alias("forged")).alias("payload"))
    manifest = build_manifest(rows)
    proved = prove(manifest).select("payload.*", "leaf", "subroot", "path")
    root = F.lit(manifest.root).cast("string")
    folded = proved.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return manifest, folded.withColumn("verified", F.col("folded_root") == F.col("root"))
