import hashlib
import random
import zlib

from foliant.llm.merkle import SEGMENT, document_manifest, fold, leaf_digest, prove
from pyspark.sql import functions as F


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tiers, i):
    out = []
    for tier in tiers[:-1]:
        out.append((tier[i - 1], "") if i % 2 else ("", tier[i + 1] if i + 1 < len(tier) else ""))
        i //= 2
    return out


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    by = {}
    for i, text, lang, source, n in rows:
        forge = n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        by.setdefault(lang, []).append((i is not None, i or 0, leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n + 1, text)) if forge else None))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for nth, (x, tree) in enumerate(zip(names, trees)):
        for i, (known, ident, leaf, forged) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            path = siblings(tree, i) + siblings(top, nth)
            folded = forged or leaf
            for a, b in path:
                folded = h(a + folded + b)
            out.append((ident if known else None, leaf, tree[-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_against_plain_python(spark):
    """Parts of several segments, of one, and of one leaf; nulls everywhere, empty and long texts, repeated ids and rows."""
    rng = random.Random(1)
    rows = [(i, f"text {i} é", "en", rng.choice(["a", "b", None]), rng.choice([None, 3, 10**12])) for i in range(2 * SEGMENT + 77)]
    rows += [(i, "x" * (i % 3), "de", "é", i) for i in range(SEGMENT)]
    rows += [(5000 + i, None, lang, None, 0) for i, lang in enumerate(["", "é", "z", None, None, None])]
    rows += [(None, "no id", "en", "a", 1)] * 40 + [(7, "same id", "fr", "a", 1), (7, "same id too", "fr", "a", 1)] + [(8, "whole row", "fr", "a", 1)] * 5
    rows += [(9, "long " * 400_000, "fr", "b", 2_000_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 as leaf", "2 as rank", "3 as part", "4 as path", "5 as key", "6 as tie", "7 as at").repartition(7)
    manifest, audit = document_manifest(df)
    got = result(audit)
    assert got == brute(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)
    held = manifest.store.select("digest").collect()
    assert len({r.digest for r in held}) == len(held)
    # some requests only, repeated, and for leaves that don't exist
    tree = manifest.trees.where("part = 'en'").first()
    asked = spark.createDataFrame([(tree.tree, r, s) for r, s in [(0, "a"), (SEGMENT, "b"), (SEGMENT, "c"), (tree.n - 1, "d"), (tree.n, "no"), (10**9, "no"), (None, "no")]], "tree long, rank long, who string")
    found = prove(manifest, asked).join(manifest.leaves.select("tree", "rank", "leaf"), ["tree", "rank"]).withColumn("root", fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r.who for r in found) == ["a", "b", "c", "d"] and {r.root for r in found} == {manifest.root}


def test_single_leaf_and_empty(spark, empty):
    one = [(1, "t", "en", None, 4)]
    assert result(document_manifest(spark.createDataFrame(one, empty.schema))[1]) == brute(one)
    manifest, audit = document_manifest(empty)
    assert audit.columns == NAMES and audit.collect() == [] and manifest.root is None


def test_leaf_of_any_columns(spark):
    row = spark.sql("select 1 a, cast(null as string) b, 'é' c").select(leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("d")).first()
    assert row.d == h("1:1-2:é")
