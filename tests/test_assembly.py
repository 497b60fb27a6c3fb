import random

from pyspark.sql import functions as F

from foliant.operators import assembly as A


def plain_snippet(content, terms):
    hits = [(content.find(t), i, len(t)) for i, t in enumerate(terms) if content.find(t) >= 0]
    if not hits:
        return content[:160]
    at, _, size = min(hits)
    b, e = max(0, at - 50), min(len(content), at + size + 90)
    return "..." * (b > 0) + content[b:e] + "..." * (e < len(content))


def plain_marks(text, terms):
    for t in sorted((t for t in terms if t.strip()), key=lambda t: -len(t)):
        text = text.replace(t, f"<em class='highlight'>{t}</em>")
    return text


def test_snippets_and_marks_against_plain_python(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abé 天") for _ in range(rng.choice([0, 3, 80, 400]))), ["".join(rng.choice("abé天") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4))]) for _ in range(200)]
    rows += [("x" * 300, []), ("the term", ["term", " "])]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "id int, c string, t array<string>")
    for r in df.select("id", A.snippet(F.col("c"), F.col("t")).alias("s"), A.marked(F.col("c"), F.col("t")).alias("m")).collect():
        c, t = rows[r.id]
        assert r.s == plain_snippet(c, t) and r.m == plain_marks(c, t)


def test_question_terms(spark):
    qs = ["请问环境评价的办理流程是什么", "环评", "  ", None, "a bb 的 ccc", "的"]
    got = spark.createDataFrame([(q,) for q in qs], "q string").select(A.core_terms(F.col("q"), ["请问", "的", "是什么"]).alias("c"), A.strip_noise(F.col("q"), ["请问", "的", "是什么"]).alias("s")).collect()
    assert [r.c for r in got] == [["环境评价", "办理流程"], ["环评"], [], [], [], []]
    assert [r.s for r in got] == ["环境评价办理流程", "环评", "  ", None, "bb ccc", "的"]


def test_keyword_results_by_hand(spark):
    docs = spark.createDataFrame([("q", 1, 10, "f1", "o1", "t1", "s1", 4.0, ["ab"]), ("q", 2, 11, "f2", "", "t2 ab", "", 2.0, ["ab"]), ("q", 3, 12, "f3", None, "", None, 0.0, ["ab"]), ("q", 4, 13, "f4", "o", "t", "s", 1.0, ["ab"]), ("r", 1, 10, "", "", "", "", 0.0, ["ab"])], "query string, rank int, doc_id int, file_name string, owner string, title string, summary string, rank_score double, terms array<string>")
    chunks = spark.createDataFrame([("q", 10, n, f"c{n}", f"x ab {n}", ["ab"]) for n in (5, 3, 1, 9)], "query string, doc_id int, nth int, chunk_id string, content string, terms array<string>")
    literal = spark.createDataFrame([("q", 1, 90, "f1", "", ""), ("q", 2, 91, "f9", "", "L"), ("q", 3, 92, "", "own", "M")], "query string, nth int, doc_id int, file_name string, owner string, title string")
    em = "<em class='highlight'>ab</em>"
    rows = {(r.query, r.place): r for r in A.keyword_results(docs, chunks, literal, "query", 3).collect()}
    got = {k: (r.doc_id, r.organization, r.score, r.chunk_text, [c.chunk_id for c in r.chunks]) for k, r in rows.items()}
    assert got == {
        ("q", 1): (91, "f9", 0.99, "", []), ("q", 2): (92, "own", 0.99, "", []), ("q", 3): (10, "o1", 0.99, f"x {em} 1", ["c1", "c3", "c5"]),
        ("q", 4): (11, "f2", 0.745, f"t2 {em}", ["11"]), ("q", 5): (12, "f3", 0.5, "f3", ["12"]), ("r", 1): (10, "", 0.5, "", []),
    }


def test_routes_by_hand(spark):
    q = spark.createDataFrame([(1, "long question", "hybrid", False, 1, 9.0, 50, 10), (2, "long question", "hybrid", True, 1, 9.0, 5, 10), (3, "abcd", "hybrid", True, 51, 9.0, 50, 10), (4, "abcd", "hybrid", True, 50, 1.2, 50, 10), (5, "x", "keyword", False, 1, 9.0, 50, 10), (6, "none", "hybrid", False, 1, 9.0, 50, 10), (7, "x", "semantic", True, 1, 9.0, 5, 25), (8, "no text", "hybrid", False, 1, 9.0, 50, 10), (9, "weak", "hybrid", True, 1, 9.0, 50, 10)], "q int, text string, mode string, navigational boolean, text_hits int, flatness double, rerank_top_k int, return_top_k int")
    c = spark.createDataFrame([(i, 0.5 if i == 9 else 5.0, "公示" if i == 7 else "通知", None if i == 8 else "t") for i in (1, 2, 3, 4, 5, 7, 8, 9)], "q int, es double, doc_type string, body string").withColumnRenamed("body", "text")
    get = lambda **k: {r.q: (r.run, r.most, r.degraded) for r in A.rerank_routes(q, c, "q", **k).collect()}
    slow = get()
    assert {i for i, r in slow.items() if r[0]} == {1, 3, 4, 9} and slow[1][1] == 12
    fast = get(fast=True)
    assert {i for i, r in fast.items() if r[0]} == {1, 3, 4, 7, 9} and fast[1][1] == 30 and fast[7][1] == 25 and get(admin=True)[1][1] == 50
    assert all(not r[0] and r[2] for r in get(breaker=True).values())


def test_common_veto_and_prompt(spark):
    rows = [("a", s, False) for s in (0.1, 0.2, 0.1, 0.1, 0.2)] + [("b", s, False) for s in (0.1, 0.2, 0.1, 0.1, 0.7)] + [("c", 0.1, False)] * 4 + [("d", 0.1, True)] * 6 + [("e", s, False) for s in (0.1, 0.1, 0.1, None, None, 0.1)]
    got = {r.q: (round(r.veto_ratio, 3), r.any_winner, r.vetoed) for r in A.collective_veto(spark.createDataFrame(rows, "q string, s double, nav boolean"), "q", "s", 0.6, "nav").collect()}
    assert got == {"a": (1, False, True), "b": (0.8, True, False), "c": (1, False, False), "d": (1, False, False), "e": (0.667, False, False)}
    ranked = [(1, "alpha 要求", r, t, s) for r, t, s in ((1, "beta", True), (2, "alpha x", False), (3, "y alpha", True), (4, "alpha", False))] + [(2, "nothing", r, "z", r == 1) for r in (1, 2, 3)] + [(3, None, 1, None, False)]
    out = A.select_for_prompt(spark.createDataFrame(ranked, "q int, question string, rank int, text string, sufficient boolean"), "q", 1, 2).collect()
    assert sorted((r.q, r.place, r["rank"]) for r in out) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (3, 1, 1)]
    enough = spark.createDataFrame([("哪些", 3, 0.4, 0.3, 0.0, 0.0), ("哪些", 2, 0.4, 0.3, 9.0, 1.0), ("x", 0, 0.0, 0.0, 2.0, 0.15), (None, 9, 1.0, 1.0, 1.9, 0.5)], "q string, h int, l double, e double, s double, c double")
    assert [r[0] for r in enough.select(A.sufficient(*[F.col(x) for x in "qhlesc"])).collect()] == [True, False, True, False]
