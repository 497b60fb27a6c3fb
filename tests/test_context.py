"""Context operators on small rows: nulls, ties, repeated rows, empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from foliant.operators import context as X
from foliant.operators import policy as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_neighbours(spark):
    chunks = spark.createDataFrame([("a", i) for i in range(6)] + [("a", 3), ("b", 0), (None, 1), ("a", None)], "doc string, at int")
    hits = spark.createDataFrame([("a", 0), ("a", 0), ("a", 4), (None, 1)], "doc string, at int")
    got = rows(X.neighbours(hits, chunks, "doc", "at", 1, 1).select("doc", "at", "source_type"))
    assert got == sorted([("a", 0, "hit"), ("a", 1, "neighbor"), ("a", 3, "neighbor"), ("a", 3, "neighbor"), ("a", 4, "hit"), ("a", 5, "neighbor")], key=repr)
    assert X.neighbours(hits.where("false"), chunks, "doc", "at", 1, 1).count() == 0


def test_siblings_take_ten_for_each_document(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(30)] + [("e", 0), ("f", 0)], "doc string, chunk int")
    c = spark.createDataFrame([("q", "d", 3, 0.4), ("q", "e", 0, 0.2), ("r", "e", 0, 0.001)], "q string, doc string, chunk int, rrf double")
    got = X.siblings(c, chunks, "q", "doc", ["chunk"], per_doc=5).select("q", "doc", "chunk", F.round("rrf", 4))
    assert rows(got) == sorted([("q", "d", i, 0.15) for i in range(11) if i != 3], key=repr)
    lone = X.siblings(c.where("q = 'r'"), chunks.unionByName(spark.createDataFrame([("e", 1)], "doc string, chunk int")), "q", "doc", ["chunk"])
    assert rows(lone.select("q", "chunk", "rrf")) == [("r", 1, 0.01)]


def test_parents(spark):
    c = spark.createDataFrame([("p", None, "coarse", "P"), ("f", "p", "fine", "F"), ("g", "gone", "fine", "G"), ("h", "p", "coarse", "H"), ("i", None, "fine", None)], "chunk_id string, parent_chunk_id string, granularity string, content string")
    got = rows(X.with_parents(c, c).select("chunk_id", "granularity", "display_content"))
    assert got == [("f", "coarse", "P"), ("g", "fine", "G"), ("h", "coarse", "H"), ("i", "fine", None), ("p", "coarse", "P")]


def test_synonyms(spark):
    table = [(1, "ab", "long ab, other", "EQUIV", 1), (2, "other", None, "ABBR", 1), (3, "x", "ab", "EQUIV", 1), (4, "no", "never", "EQUIV", 0)]
    keys = X.synonym_keys(spark.createDataFrame(table, "id int, abbr string, full_terms string, kind string, enabled int"))
    assert {r["key"]: r["terms"] for r in keys.collect()} == {"ab": ["ab", "long ab", "other"], "long ab": ["ab", "long ab", "other"], "other": ["other"], "x": ["x", "ab"]}
    q = spark.createDataFrame([(1, "some other thing"), (2, "x"), (3, ""), (4, None), (5, "nothing")], "id int, text string")
    assert rows(X.expand_synonyms(q, keys, ["id"])) == [(1, ["other"]), (2, ["ab", "x"])]
    assert X.expand_synonyms(q, keys.where("false"), ["id"]).count() == 0


def test_clauses_and_highlight(spark):
    r = spark.createDataFrame([("how is this done？ short, and what does it cost", "The bathe.* the")], "q string, t string")
    got = r.select(X.clauses(F.col("q")).alias("c"), X.highlight(F.col("t"), "the bathe.* a", None).alias("h")).first()
    assert got["c"] == ["how is this done", "and what does it cost"]
    mark = "<em class='highlight'>{}</em>".format
    assert got["h"] == f"{mark('The')} {mark('ba' + mark('the') + '.*')} {mark('the')}"


def test_fielded_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox", "a red red fox"), (2, None, "fox"), (3, "blue", None), (4, "red", "red")], "doc_id int, title string, body string")
    got = {r["doc_id"]: r["score"] for r in X.fielded_bm25(docs, "red", {"title": 10.0, "body": 4.0}, {"title": 18.0}).collect()}
    assert set(got) == {1, 4} and got[4] > 18 > got[1] > 0
    assert X.fielded_bm25(docs.where("false"), "red", {"title": 10.0}).count() == 0


def test_merge_candidates(spark):
    schema = "doc_id string, source string, recall string"
    c = spark.createDataFrame([("1", "s", "knn"), ("", "s", ""), (None, "t", "doc_search"), ("2", None, None)], schema)
    f = spark.createDataFrame([("1", None), ("1", "z"), ("", "s"), ("", "t"), ("9", "")], "doc_id string, source string")
    assert rows(X.merge_candidates(c, f, "doc_search")) == [("id:1", "knn,doc_search"), ("id:2", ""), ("id:9", "doc_search"), ("source:s", "doc_search"), ("source:t", "doc_search")]


def plain_assembly(docs, pairs, max_docs, per_doc, total, max_chars):
    out, seen, used = [], set(), 0
    for (_, file), group in itertools.groupby(sorted(d for d in docs if d[1] <= max_docs), lambda d: (d[1], d[0])):
        n = 0
        for _, _, _, text in group:
            if len(out) >= total or n >= per_doc or used >= max_chars:
                break
            if text and (file, text) not in seen:
                seen.add((file, text))
                out.append((file, "doc_chunk", text))
                n, used = n + 1, used + len(text)
    covered = {o[0] for o in out}
    for file, _, latest, text in sorted(pairs, key=lambda p: p[1]):
        if len(out) >= total or used >= max_chars:
            break
        if latest is not False and text and file not in covered:
            covered.add(file)
            out.append((file, "qa_pair", text))
            used += len(text)
    return out


@pytest.mark.parametrize("caps", [(2, 2, 9, 99), (3, 1, 9, 99), (3, 2, 3, 99), (3, 2, 9, 7), (1, 1, 9, 9)])
def test_assembled_evidence(spark, caps):
    docs = [("a", 1, 1, "one"), ("a", 1, 2, "one"), ("a", 1, 3, "two"), ("a", 1, 4, "six"), ("b", 2, 5, "one"), ("b", 2, 6, ""), ("c", 3, 7, None), ("c", 3, 8, "ten")]
    pairs = [("a", 1, True, "covered"), ("x", 2, False, "old"), ("x", 3, None, "new"), ("x", 4, True, "later"), ("c", 5, True, "pair"), ("y", 6, True, None)]
    d = spark.createDataFrame([("q", *r) for r in docs], "q string, file string, doc_rank int, place int, text string")
    p = spark.createDataFrame([("q", *r) for r in pairs], "q string, file string, place int, is_latest boolean, text string")
    got = X.assemble_evidence(d, p, "q", *caps).orderBy("n").collect()
    assert [(r["file"], r["kind"], r["text"]) for r in got] == plain_assembly(docs, pairs, *caps)
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))


def test_claims(spark):
    facts = spark.createDataFrame([(1, "f1", 2), (1, "f2", 0)], "plan int, fact string, citation int")
    claims = spark.createDataFrame([(1, "c1", ["f1"], [2]), (1, "c2", [], [0]), (1, "c3", ["f9"], None), (2, "c4", ["f1"], [2])], "plan int, claim string, facts array<string>, citations array<int>")
    assert rows(X.claim_errors(claims, facts, "plan")) == sorted(
        [(1, "c2", "claim_missing_fact", None), (1, "c2", "claim_unknown_citation", "0"), (1, "c3", "claim_unknown_fact", "f9"), (1, "c3", "claim_missing_citation", None), (2, "c4", "claim_unknown_fact", "f1"), (2, "c4", "claim_unknown_citation", "2")], key=repr
    )


def test_newest_and_readable(spark):
    r = spark.createDataFrame([("h", 1, "a"), ("h", 2, "b"), ("h", 2, "c"), ("i", None, "d")], "h string, v int, source string")
    assert rows(X.newest_of_hash(r, "h", "v").select("source")) == [("b",), ("c",)]
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    rules = spark.createDataFrame([("a", "u", "ALLOW"), ("a", "v", "DENY"), ("b", "u", "ALLOW"), ("c", "w", "ALLOW")], "name string, subject string, effect string")
    get = lambda *a, **k: [r[0] for r in rows(X.readable_indices(names, rules, "name", *a, **k))]
    assert get(["u", "v"]) == ["b", "d"] and get([]) == ["d"] and get(["u"], default_deny=True) == ["a", "b"] and get([], admin=True) == ["a", "b", "c", "d"]


def test_screened_rows(spark):
    rules = [P.Policy(1, "WORD", "aa", "MASK", "*"), P.Policy(2, "WORD", "stop", "BLOCK_QA", priority=9)]
    t = spark.createDataFrame([(1, "aaaa", None), (2, "fine", "stop aa"), (3, "stop aa", "aa"), (4, None, None), (5, "aa", "stop")], "id int, a string, b string")
    got = {r["id"]: r for r in P.screen_rows(t, ["a", "b"], rules).collect()}
    assert [got[i]["blocked"] for i in range(1, 6)] == [False, True, True, False, True]
    assert got[1]["a"] == "**" and got[1]["sensitive_filtered"] and got[4]["a"] is None and not got[4]["sensitive_filtered"]
    hits = {i: [(h["field"], list(h["policies"]), h["hits"]) for h in got[i]["hits"]] for i in got}
    assert hits == {1: [("a", [1], 3)], 2: [("b", [2], 1)], 3: [("a", [2], 1)], 4: [], 5: [("a", [1], 1), ("b", [2], 1)]}
