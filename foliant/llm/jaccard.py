"""Exact n-gram Jaccard join with prefix, length, positional and suffix filters.

1. Shingle frequencies: every task counts all shingles of its documents in a table of ``BUCKETS`` hash buckets, the
   tables are summed in a tree, and the sums (a fixed 4 MB) order shingles rare-first.  Any one order gives exact
   results; a rarer prefix only gives fewer candidates.
2. Documents with equal shingle sets become one representative.  Each representative gives its prefix in that order
   and a sketch: how many of its shingles fall in each of ``PARTS`` hash ranges.
3. Documents meet on prefix shingles.  In every list of a shingle all members are first held against one leader,
   drawn by a hash of shingle and id, so that the lists of a group of copies have many leaders.  Candidates that pass
   the length and positional filters are taken once per pair, the suffix filter compares the partition sizes (their summed difference is at most the size of the symmetric difference),
   and the rest is verified on the texts.
4. Components of these links.  In lists whose members still belong to several components, members outside the
   list's main component are held against all others in blocks of bounded size, so a group of copies is never
   expanded into all its pairs; pairs within a component need no further look.  Components of all links are final.
5. Numbers of links, where asked for.  Inside a component nearly all pairs may link, so each representative is reduced to
   the shingles in which it differs from the component's leader (the symmetric difference of two sets is that of their
   differences), representatives are blocked by length band and hash, and a product of two blocks' matrices verifies
   each pair once.  Only numbers leave a block; work grows with the square of a component's different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_ids, may_hold, settle, spread, trimmed, with_keys
from .graph import components

BUCKETS_LOG2, BLOCKS, PARTS = 20, 64, 256
#: Count tables summed in one group.
FAN_IN = 64
#: Members of a list held against each other at once: outside the main component, and all.
REST_BLOCK, ALL_BLOCK = 128, 256
#: Words whose hash is kept while a task runs.
CACHED_WORDS = 100_000
#: Documents whose shingles are held at once.
SLICE = 256
#: Members, and shingles of their differences, in one block of a component; members for each copy of a leader's text.
COUNT_BLOCK, COUNT_SHINGLES, MEMBERS_A_LEADER = 256, 1_000_000, 500
#: Columns of a block's matrix at once.
COLUMNS = 4_096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; of all words where there are fewer; else empty."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []  # splits at the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ h[j : len(h) - n + 1 + j]) * _MIX
        s ^= s >> np.uint64(31)
    return np.unique(s)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def shingle_counts(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """Occurrences in all documents (once a document) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS_LOG2, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                sets = [shingle_set(t.as_py(), n) for t in batch.column(0).slice(lo, SLICE)]
                at, held = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
                total[at] += held
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in np.split(total, BLOCKS)])], names=["block", "part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "block int, part int, counts binary"
    rows = spread(docs.select(text))
    parts = rows.rdd.getNumPartitions()
    sums = settle(rows.mapInArrow(trimmed(run), schema), "shingle-counts")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("slice", F.col("part") % parts).groupBy("block", "slice").applyInPandas(add, schema)
    found = sums.select("block", "counts").collect()  # BLOCKS rows of fixed size
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(found, key=lambda r: r["block"])])


def _needed(total, num: int, den: int):
    """Least intersection of two sets with so many elements in all."""
    return -(-num * total // (num + den))


def _prefixes(docs: DataFrame, counts: np.ndarray, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            size, sig, prefix, sketch = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), n)
                size.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                first = np.argsort(order[_bucket(s)], kind="stable")[: len(s) - -(-num * len(s) // den) + 1]
                prefix.append(s[first].view(np.int64))
                sketch.append(np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
            offsets = np.r_[0, np.cumsum([len(x) for x in prefix])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), lists, pa.array(sketch, pa.binary())], names=["id", "n", "sig", "prefix", "sketch"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return settle(rows.mapInArrow(trimmed(run), "id long, n long, sig binary, prefix array<long>, sketch binary"), "prefixes")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b), each once -> true links: suffix filter on sketches, then the texts themselves."""
    sketches = sets.select("id", "n", "sketch")
    both = pairs.join(sketches.withColumnsRenamed({"id": "a", "n": "na", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"id": "b", "n": "nb", "sketch": "sb"}), "b")

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            total = x.column("na").to_numpy() + x.column("nb").to_numpy()
            keep = _sketch_apart(_sketches(x.column("sa")), _sketches(x.column("sb"))) <= total - 2 * _needed(total, num, den)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(keep)), x.column("b").filter(pa.array(keep))], names=["a", "b"])

    pairs = settle(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(suffix), "a long, b long"), "pairs-kept")
    texts = docs.where(may_hold(pairs.select(F.explode(F.array("a", "b")).alias("id")))(F.col("id")))
    with_texts = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(64)(lambda text: shingle_set(text, n))
        for x in batches:
            keep = []
            for ta, tb in zip(x.column("ta"), x.column("tb"), strict=True):
                sa, sb = of(ta.as_py()), of(tb.as_py())
                inter = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(den * inter >= num * (len(sa) + len(sb) - inter))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(keep), x.column("b").filter(keep)], names=["a", "b"])

    return settle(with_texts.select("a", "b", "ta", "tb").mapInArrow(trimmed(verify), "a long, b long"), "links")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, PARTS).astype(np.int16)


def _sketch_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y).sum(axis=-1, dtype=np.int64)


def _cross_pairs(num: int, den: int):
    """Rows sorted by (token, ra, rb): pairs of a rest member and any member that pass all filters."""

    def flush(k: dict) -> Iterator[pa.RecordBatch]:
        key = np.stack([k["token"], k["ra"], k["rb"]])
        cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, key.shape[1]]
        out = []
        for lo, hi in zip(cut, cut[1:], strict=False):
            rest, every = lo + np.flatnonzero(k["role"][lo:hi] == 0), lo + np.flatnonzero(k["role"][lo:hi] == 1)
            i, j = (x.ravel() for x in np.meshgrid(rest, every, indexing="ij"))
            ok = (k["label"][i] != k["label"][j]) & ((k["rest"][j] == 0) | (k["id"][i] < k["id"][j]))
            i, j = i[ok], j[ok]
            total = k["n"][i] + k["n"][j]
            need = _needed(total, num, den)
            ok = (den * np.minimum(k["n"][i], k["n"][j]) >= num * np.maximum(k["n"][i], k["n"][j])) & (np.minimum(k["n"][i] - k["pos"][i], k["n"][j] - k["pos"][j]) >= need)
            i, j, total, need = i[ok], j[ok], total[ok], need[ok]
            ok = _sketch_apart(k["sketch"][i], k["sketch"][j]) <= total - 2 * need
            out.append(np.stack([k["id"][i[ok]], k["id"][j[ok]]]))
        a, b = np.concatenate(out, axis=1)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for x in batches:
            if not x.num_rows:
                continue
            new = {c: (_sketches(x.column(c)) if c == "sketch" else x.column(c).to_numpy()) for c in x.schema.names}
            held = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
            last = tuple(held[c][-1] for c in ("token", "ra", "rb"))  # the last block may go on in the next batch
            open_ = np.all([held[c] == v for c, v in zip(("token", "ra", "rb"), last, strict=True)], axis=0)
            done = int(np.argmax(open_))
            if done:
                yield from flush({c: v[:done] for c, v in held.items()})
                held = {c: v[done:] for c, v in held.items()}
        if held:
            yield from flush(held)

    return run


def _differences(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(id, label, copies, n, diff) of every node: the shingles in which its text and that of its component's leader differ."""
    texts = docs.where(may_hold(nodes, "node")(F.col("id"))).join(nodes, F.col("id") == F.col("node")).drop("node")
    texts = settle(texts.select("id", "label", "members", "copies", "text"), "component-texts")
    parts = F.ceil(F.col("members") / MEMBERS_A_LEADER).cast("int")
    leaders = texts.where("id = label").groupBy("label", "members").agg(F.min("text").alias("lead"))
    leaders = leaders.select(F.col("label").alias("l_"), "lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p_"))
    both = texts.withColumn("p", F.pmod(F.xxhash64("id"), parts).cast("int")).join(leaders, (F.col("label") == F.col("l_")) & (F.col("p") == F.col("p_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(8)(lambda text: shingle_set(text, n))
        for x in batches:
            size, diff = [], []
            for text, lead in zip(x.column("text"), x.column("lead"), strict=True):
                own = shingle_set(text.as_py(), n)
                size.append(len(own))
                diff.append(np.setxor1d(own, of(lead.as_py()), assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("id", "label", "copies")), pa.array(size, pa.int64()), pa.array(diff, pa.binary())], names=["id", "label", "copies", "n", "diff"])

    return settle(both.select("id", "label", "copies", "text", "lead").mapInArrow(trimmed(run), "id long, label long, copies long, n long, diff binary"), "differences")


def _block_links(num: int, den: int):
    """Rows sorted by block pair: for every member the copies of the members of the other block that it links with."""
    key = ("label", "band", "up", "a", "b")

    def matrix(of: np.ndarray, token: np.ndarray, rows: int, lo: int) -> np.ndarray:
        out = np.zeros((rows, COLUMNS), np.float32)
        a, b = np.searchsorted(token, (lo, lo + COLUMNS))
        out[of[a:b], token[a:b] - lo] = 1
        return out

    def side(diffs: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(diffs)), [len(d) for d in diffs])
        every = np.concatenate(diffs)
        at = np.minimum(np.searchsorted(shared, every), max(len(shared) - 1, 0))
        ok = shared[at] == every if len(shared) else np.zeros(len(every), bool)
        order = np.argsort(at[ok], kind="stable")
        return of[ok][order], at[ok][order]

    def count(k: dict) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(k["role"] != 1), np.flatnonzero(k["role"] != 0)
        same = bool((k["role"] == 2).any())
        if not len(left) or not len(right) or (same and len(left) < 2):
            return
        diffs = [np.frombuffer(d, np.uint64) for d in k["diff"]]
        dl, dr = [diffs[i] for i in left], [diffs[i] for i in right]
        if same:
            shared, times = np.unique(np.concatenate(dl), return_counts=True)
            shared = shared[times > 1]
        else:
            shared = np.intersect1d(np.concatenate(dl), np.concatenate(dr))
        l, r = side(dl, shared), side(dr, shared)
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(shared), COLUMNS):
            both += matrix(*l, len(left), lo) @ matrix(*r, len(right), lo).T
        apart = np.array([len(d) for d in dl])[:, None] + np.array([len(d) for d in dr])[None, :] - 2 * both.astype(np.int64)
        total = k["n"][left][:, None] + k["n"][right][None, :]
        link = 2 * num * total <= (num + den) * (total - apart)
        link &= k["id"][left][:, None] != k["id"][right][None, :]
        yield pa.RecordBatch.from_arrays([pa.array(k["id"][left]), pa.array(link @ k["copies"][right])], names=["id", "more"])
        if not same:
            yield pa.RecordBatch.from_arrays([pa.array(k["id"][right]), pa.array(k["copies"][left] @ link)], names=["id", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for x in batches:
            if not x.num_rows:
                continue
            new = {c: (np.array(x.column(c).to_pylist(), object) if c == "diff" else x.column(c).to_numpy()) for c in x.schema.names}
            held = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
            keys = np.stack([held[c] for c in key])
            cut = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]  # the last pair may go on in the next batch
            for lo, hi in zip(cut, cut[1:], strict=False):
                yield from count({c: v[lo:hi] for c, v in held.items()})
            held = {c: v[cut[-1] :] for c, v in held.items()}
        if held:
            yield from count(held)

    return run


def link_counts(docs: DataFrame, labels: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(rep, more): the documents in other classes that each representative links with."""
    nodes = labels.join(classes.where("rep is not null").groupBy("rep").agg(F.sum("copies").alias("copies")), F.col("node") == F.col("rep")).select("node", "label", "copies")
    per_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("all")).withColumnRenamed("label", "l_")
    nodes = settle(nodes.join(per_label, F.col("label") == F.col("l_")).drop("l_"), "component-nodes")
    pairs = nodes.where("members = 2").select(F.col("node").alias("id"), (F.col("all") - F.col("copies")).alias("more"))  # a component of two has its one link
    diffs = _differences(docs, nodes.where("members > 2").drop("all"), n)
    # lengths of linked sets differ by den / num at most: they are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n")) / F.lit(np.log(den / num) * (1 + 1e-9))) if num < den else F.lit(0)
    diffs = diffs.withColumn("band", band.cast("int"))
    held = diffs.groupBy("label", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("diff") / 8).alias("shingles"))
    held = held.select("label", "band", F.greatest(F.ceil(F.col("rows") / COUNT_BLOCK), F.ceil(F.col("shingles") / COUNT_SHINGLES)).cast("int").alias("blocks"))
    by_band = Window.partitionBy("label").orderBy("band")
    beside = lambda step, shift: F.when(shift("band").over(by_band) == F.col("band") + step, shift("blocks").over(by_band)).otherwise(0)
    held = settle(held.select(F.col("label").alias("l_"), F.col("band").alias("b_"), "blocks", beside(1, F.lead).alias("above"), beside(-1, F.lag).alias("below")), "count-blocks")
    diffs = diffs.join(held, (F.col("label") == F.col("l_")) & (F.col("band") == F.col("b_"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    to = lambda blocks: F.filter(F.sequence(F.lit(0), F.col(blocks)), lambda j: j < F.col(blocks))
    pair = lambda low, up, a, b, role: F.struct(low.cast("int").alias("band"), F.lit(up).alias("up"), a.alias("a"), b.alias("b"), role.cast("int").alias("role"))
    here = F.transform(to("blocks"), lambda j: pair(F.col("band"), 0, F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.when(j == F.col("own"), 2).when(j > F.col("own"), 0).otherwise(1)))
    over = F.transform(to("above"), lambda j: pair(F.col("band"), 1, F.col("own"), j, F.lit(0)))
    under = F.transform(to("below"), lambda j: pair(F.col("band") - 1, 1, j, F.col("own"), F.lit(1)))
    dealt = diffs.withColumn("to", F.explode(F.concat(here, over, under))).select("label", "to.*", "id", "n", "copies", "diff")
    dealt = dealt.repartition("label", "band", "up", "a", "b").sortWithinPartitions("label", "band", "up", "a", "b")
    counted = dealt.mapInArrow(trimmed(_block_links(num, den)), "id long, more long").unionByName(pairs)
    return settle(counted.groupBy("id").agg(F.sum("more").alias("more")).withColumnRenamed("id", "rep"), "link-counts")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """Per document row: (id, n_shingles, component_id); links are pairs with intersection / union >= num / den.

    With ``count_links`` also n_links: the other document rows that a row links with, those of equal sets included.

    A text without words, or null, has an empty set and links with nothing: its component is its own id.  Documents of
    equal sets are one component.  Rows that repeat are answered row by row; where an id repeats with different texts
    they are one node, with the links of all of them.  A null id takes part through equal sets only and has the component
    of its class (null where no other row shares it).  Very long texts are compared whole.  An empty table gives no rows.
    """
    links, members, classes = jaccard_links(docs, n, num, den, id_col, text_col)
    label = members.withColumns({"label": F.lit(None).cast("long"), "more": F.lit(0).cast("long")})
    if links is not None:
        labels = settle(components(links), "labels")
        label = members.join(labels, members["rep"] == labels["node"], "left").drop("node")
        if count_links:
            more = link_counts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), labels, classes, n, num, den)
            label = label.join(more, "rep", "left")
    out = label.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "rep")).alias("component_id"),
        *([(F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links")] if count_links else []),
    )
    return out


def jaccard_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Links (a, b) between representatives that join all components, the membership (id, n, rep, copies), the classes (sig, rep, copies).

    Links inside a component that other links already join are not all listed; None stands for no candidates.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prefixes = _prefixes(docs, shingle_counts(docs, n, text_col), n, num, den, id_col, text_col)
    best = F.min_by(F.struct("n", "prefix", "sketch"), "id")
    sets = settle(prefixes.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("id"), best.alias("s")).select("sig", "id", "s.*"), "sets")
    classes = settle(prefixes.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumnRenamed("sig", "sig_"), "classes")
    members = prefixes.join(classes, prefixes["sig"] == classes["sig_"], "left").select("id", "n", "rep", "copies")

    postings = sets.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    leaders = settle(postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min_by(F.struct("n", "id", "pos"), F.xxhash64("id", "token")).alias("lead")).where("held > 1"), "leaders")
    lists = settle(postings.join(leaders, "token"), "lists")
    if lists.isEmpty():
        return None, members, classes
    need = f"cast(ceil({num} * (n + lead.n) / {num + den}) as long)"
    star = lists.where(f"id <> lead.id and {den} * least(n, lead.n) >= {num} * greatest(n, lead.n) and least(n - pos, lead.n - lead.pos) >= {need}")
    star = star.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
    links = _verified(rows, sets, star, n, num, den)

    labels = settle(components(links), "star-labels")
    rest = lists.where("held > 2 and id <> lead.id").select("token", "id", "n", "pos")
    rest = settle(rest.join(labels, rest["id"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "id")), "list-labels")
    per_label = rest.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    state = per_label.groupBy("token").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    state = settle(state.select("token", F.col("main.label").alias("main"), F.ceil((F.col("size") - F.col("main.c")) / REST_BLOCK).cast("int").alias("blocks_a"), F.ceil(F.col("size") / ALL_BLOCK).cast("int").alias("blocks_b")), "open-lists")
    open_ = rest.join(state, "token")
    open_ = open_.join(sets.select("id", "sketch"), "id").withColumn("rest", (F.col("label") != F.col("main")).cast("int"))
    own = lambda seed, blocks: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(blocks)).cast("int")
    to = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    as_rest = F.when(F.col("rest") == 1, F.transform(to("blocks_b"), lambda b: F.struct(F.lit(0).alias("role"), own(1, "blocks_a").alias("ra"), b.alias("rb")))).otherwise(F.array().cast("array<struct<role:int,ra:int,rb:int>>"))
    as_any = F.transform(to("blocks_a"), lambda a: F.struct(F.lit(1).alias("role"), a.alias("ra"), own(2, "blocks_b").alias("rb")))
    dealt = open_.withColumn("to", F.explode(F.concat(as_rest, as_any))).select("token", "id", "n", "pos", "label", "rest", "sketch", "to.*")
    dealt = dealt.repartition("token", "ra", "rb").sortWithinPartitions("token", "ra", "rb")
    crossed = settle(dealt.mapInArrow(trimmed(_cross_pairs(num, den)), "a long, b long").distinct(), "cross-pairs")
    if not crossed.isEmpty():
        links = links.unionByName(_verified(rows, sets, crossed, n, num, den))
    return links, members, classes


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document row of each component, that with the smallest id; documents without words stay.

    Rows that repeat an id, or have none, are told apart: each is a document of its own, after those with an id of their own.
    """
    keyed, key = with_keys(docs, id_col)
    found = jaccard_components(keyed, n, num, den, key, text_col)
    gone = found.where((F.col(key) != F.col("component_id")) & (F.col("n_shingles") > 0)).select(key)
    return drop_ids(keyed, gone, key).select(*docs.columns)
