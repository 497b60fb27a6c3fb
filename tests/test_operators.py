import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import access as A
from foliant.operators import chunking as K
from foliant.operators import cleaning as C
from foliant.operators import literals as L
from foliant.operators import policy as P
from foliant.operators import search as S
from foliant.operators import versions as V
from foliant.sources.parsers import docx_outline, file_kind, outline


def test_acl_payload_policies(spark):
    rows = [(["a"], None, None), (None, '["b"]', "c"), (None, None, "c，d, "), (None, "bad", None), (None, None, None)]
    df = spark.createDataFrame(rows, "t array<string>, j string, l string")
    got = [r[0] for r in df.select(A.resolve_tokens(F.col("t"), F.col("j"), F.col("l"))).collect()]
    assert got == [["a"], ["b"], ["c", "d"], [A.NO_ACCESS], [A.NO_ACCESS]]
    assert df.limit(5).select(A.resolve_tokens(F.col("t"), F.col("j"), F.col("l"), "internal")).collect()[4][0] == ["_INTERNAL"]
    with pytest.raises(Exception, match="acl_tokens are missing"):
        df.select(A.resolve_tokens(F.col("t"), F.col("j"), F.col("l"), "error")).collect()


def test_sibling_departments_stay_apart(spark):
    tree = [("62", None), ("6201", "62"), ("620102", "6201"), ("620103", "6201"), ("620102900000", "620102")]
    up = A.ancestors(spark.createDataFrame(tree, "code string, parent string")).orderBy("code", "depth").collect()
    chains = {}
    for r in up:
        chains.setdefault(r.code, []).append(r.ancestor)
    assert chains["620102900000"] == ["620102900000", "620102", "6201", "62"] and chains["62"] == ["62"]
    doc = spark.createDataFrame([(["dept::620102", "dept::6201", "dept::62"], "DEPT", ["620102", "6201"], "u1"), (None, None, None, "u2"), (["public"], None, None, None)], "tokens array<string>, vis string, units array<string>, owner string")
    seen = lambda who: [r[0] for r in doc.select(A.readable(who, F.col("tokens"), F.col("vis"), F.col("units"), F.col("owner"))).collect()]
    sibling = A.Identity("u9", ("620103", "6201", "62"))
    own = A.Identity("u2", ("620102", "6201", "62"))
    # the shared ancestor matches by token, so the unit clause must name the own unit only
    assert seen(A.Identity("u9", ("620103",))) == [False, False, True] and seen(own) == [True, True, True]
    assert seen(A.Identity()) == [False, False, True] and seen(A.Identity(admin=True)) == [True, True, True]
    assert "dept::6201" in sibling.tokens()


def test_decisions(spark):
    docs = spark.createDataFrame([("a", "INDEXED", None, None, "u1"), ("b", "DELETED", "PUBLIC", None, "u1"), ("c", "INDEXED", "GRANT", None, "u2"), ("d", "INDEXED", "PUBLIC", None, "u2")], "source_name string, status string, visibility string, chain array<string>, owner string")
    effects = spark.createDataFrame([("d", "ALLOW"), ("d", "DENY")], "source_name string, effect string")
    grants = spark.createDataFrame([("c", "u1")], "source_name string, grantee_id string")
    got = {r.source_name: r.reason for r in A.decide(docs, A.fold_decisions(effects, ["source_name"]), grants, A.Identity("u1")).collect()}
    assert got == {"a": "allow:owner", "b": "deny:deleted", "c": "allow:grant", "d": "deny:acl"}


def test_policies():
    alice = [P.Policy(1, "WORD", "secret", "MASK", "***", priority=1), P.Policy(2, "WORD", "Alice", "MASK", "[PERSON]", priority=2)]
    assert P.filter_text("Alice knows the secret.", alice) == ("[PERSON] knows the ***.", False, [2, 1], 2)
    block = [P.Policy(3, "WORD", "secret", "BLOCK_QA")]
    assert P.filter_text("a secret", block) == ("", True, [3], 1)
    assert P.filter_text("aaaa!", [P.Policy(4, "REGEX", "(a+)+$")])[0] == "aaaa!" and P.safe_regex("x" * 300) is None
    assert P.Policy(5, "WORD", "x", subject_type="ROLE", subject_value="r").applies("QA", roles=("r",)) and not P.Policy(6, "WORD", "x", stage="SEARCH").applies("QA")


def test_cleaning(spark):
    text = "标题行内容很长很长\n同一行内容\n同一行内容\n同一行内容\n机密\n水印\n\n哈哈哈哈哈\n��������x\n--------\n|---|---|\n|密|密|\n最后一行 with  blanks"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.cleaned for r in C.clean_documents(df).collect()}
    assert got == {1: "标题行内容很长很长\n同一行内容\n同一行内容\n最后一行 with  blanks", 2: "", 3: ""}
    assert C.clean_text("页眉文字在此\n甲乙丙丁戊己庚辛壬癸\n" * 3, margins=True) == "" and C.clean_text("AAAAABBBBB\nx\n" * 3).count("x") == 3
    assert C.clean_text("line one is here\n" * 2 + "\n" + "line one is here\n" * 3).count("one") == 4  # a blank line starts a new run
    boxes = [(1, p, y0, y1, t) for p in range(3) for y0, y1, t in ((0.0, 5.0, "页眉 2024-01-0%d" % (p + 1)), (50.0, 60.0, "body"), (95.0, 100.0, f"第 {p} 页"))]
    drop = C.repeated_margins(spark.createDataFrame(boxes, "doc_id int, page_idx int, y0 double, y1 double, text string")).where("drop").count()
    assert drop == 6
    pages = spark.createDataFrame([(1, "SUCCESS"), (1, "FAILED"), (1, "FAILED"), (2, "SUCCESS")], "doc_id int, status string")
    assert {r.doc_id: r.gate for r in C.parse_gate(pages).collect()} == {1: "ERROR", 2: "OK"}


def test_document_types_and_chunks(spark):
    law = "第一章 总则\n第一条 为了规范管理工作，根据有关法律制定本条例，适用于全省范围。\n（一）有关部门应当履行职责，并向社会公布办理的结果和期限\n第二条 本条例自发布之日起施行，由省政府负责解释工作。"
    talk = "询问笔录\n依据《刑事诉讼法》，派出所立案\n问：你叫什么名字\n答：我叫张三\n问：住在哪里\n答：住在兰州\n城关区"
    df = spark.createDataFrame([(1, law, "s"), (2, talk, "s"), (3, "One sentence here is long. Another one follows it now! End", "s"), (4, None, "s")], "doc_id long, text string, source string")
    kinds = {r[0]: r[1] for r in df.select("doc_id", K.document_type(F.col("text"))).collect()}
    assert kinds == {1: "法规", 2: "公安文书", 3: "通用", 4: "通用"}
    chunks = K.chunk_documents(df)
    fine = {(r.doc_id, r.seq): (r.section_path, r.content) for r in chunks.where("granularity = 'fine'").collect()}
    first, item = law.split("\n")[1:3]
    assert fine == {
        (1, 0): ("第一条/（一）", f"{first}：{item}"),
        (1, 1): ("第一条", f"[第一条] {first}\n{item}"),
        (1, 2): ("第二条", "[第二条] 第二条 本条例自发布之日起施行，由省政府负责解释工作。"),
        (2, 0): ("问答/第1对", "[询问笔录] 问：你叫什么名字 答：我叫张三"),
        (2, 1): ("问答/第2对", "[询问笔录] 问：住在哪里 答：住在兰州 城关区"),
        (3, 0): ("", "One sentence here is long. Another one follows it now! End"),
    }
    paths = {r.section_path for r in chunks.where("doc_id = 1 and granularity = 'coarse'").collect()}
    assert paths == {"第一章 总则"}
    assert K.link_parents(chunks).where("doc_id = 3 and parent_chunk_id is not null").count() >= 1
    assert [len(p) for p in K.split_long("a" * 30 + ". " + "b" * 700, 250, 200)] == [31, 250, 250, 200]


def test_fine_chunks_by_hand():
    rule = "前言不入细片\n第三条 申请人应当符合下列条件，并按规定提交有关的材料：\n（一）具有独立承担民事责任的能力并且依法登记注册\n住所在本省\n但有下列情形的：\n（一）有违法记录且未满三年的单位一律不得提出申请\n第一款 主管部门应当自收到申请之日起二十日内作出决定\n依据《安全法》第三条执行"
    got = [("/".join(c.path), c.content) for c in K.fine_chunks(rule)]
    head = "第三条 申请人应当符合下列条件，并按规定提交有关的材料"
    assert got[0] == ("第三条/（一）", f"[设立条件] {head}：（一）具有独立承担民事责任的能力并且依法登记注册 住所在本省")
    assert got[1] == ("第三条/但书/（一）", "但有下列情形的：（一）有违法记录且未满三年的单位一律不得提出申请")
    assert got[2][0] == "第三条/但书/第一款" and got[2][1].endswith("作出决定 依据《安全法》第三条执行")
    assert got[3] == ("第三条/但书", "[第三条/但书] " + rule.split("\n", 1)[1]) and len(got) == 4
    minutes = "会议决定如下：\n一、同意城关区提出的供水改造方案\n由住建局牵头\n二、散会"
    assert [c.content for c in K.fine_chunks(minutes)][:1] == ["[会议决议] 一、同意 一、同意城关区提出的供水改造方案 由住建局牵头"]
    table = "|姓名|职务|\n|---|---|\n|张三丰|主任科员|\n|李四|x|"
    assert [(c.kind, c.content) for c in K.fine_chunks(table)] == [("table", "姓名: 张三丰，职务: 主任科员")]
    long = "第一条 " + "这是一个完整的句子并且不太短。" * 40
    parts = [c.content for c in K.fine_chunks(long, 250)]
    assert len(parts) == 3 and parts[0].startswith("[第一条（第1段）] 第一条") and "".join(p.split("] ", 1)[1] for p in parts) == long
    report = "会议总结\n一是加强组织领导和统筹协调工作；二是压实各级各部门的主体责任；三是强化督促检查和结果运用。"
    assert len(K.fine_chunks(report)) == 3


def test_overlapping_words_are_counted():
    p = P.Policy(1, "WORD", "aa")
    assert P.filter_text("aaaa", [p]) == ("[REDACTED]" * 2, False, [1], 3) and P.occurrences("a" * 5000, "aa") == 1000 and P.occurrences("x", "") == 0


def test_regexes_search_texts_of_any_length():
    rules = [P.Policy(1, "REGEX", "mor[o]n", "MASK", "*"), P.Policy(2, "REGEX", "i[d]iot", "BLOCK_QA")]
    for n in (0, 199_993, 199_994, 199_995, 1_500_000):
        x = "x" * n
        assert P.filter_text(x + " moron", rules) == (x + " *", False, [1], 1) and P.filter_text(x + " idiot", rules) == ("", True, [2], 1)

def test_automaton_against_naive_search():
    rng = random.Random(1)
    naive = lambda t, w: sum(t.startswith(w, i) for i in range(len(t))) if w else 0
    for _ in range(60):
        words = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 9))]
        texts = ["".join(rng.choice("abcé😀") for _ in range(rng.choice([0, 1, 5, 50, 2100]))) for _ in range(rng.randrange(1, 6))]
        machine = L.build(words)
        assert machine.counts(texts, 1000) == [{i: min(1000, naive(t, w)) for i, w in enumerate(words) if naive(t, w)} for t in texts]
        text, word, end = machine.hits(texts)
        assert all(texts[t][e - len(words[w]) : e] == words[w] for t, w, e in zip(text, word, end))
    with pytest.raises(ValueError):
        L.build(["".join(map(chr, range(k, k + 40000))) for k in (100, 70000)])


def test_ten_thousand_words_in_one_pass(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(10_000)})
    texts = [None, "", "x" * 50_000] + [" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(300)) for _ in range(40)]
    got = {(r.id, r.word): r.hits for r in P.word_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3), words, "id", "text").collect()}
    want = {}
    for i, t in enumerate(texts):
        for w in words:
            if t and w in t:
                want[i, w] = sum(t.startswith(w, k) for k in range(len(t)) if t[k] == w[0])
    assert got == want


def test_policies_one_by_one_are_the_same_as_together():
    """Counts of the text as it stands, masks in order, own hits of each policy, actions that only count."""
    rng = random.Random(3)
    make = lambda i: P.Policy(i, *rng.choice([("WORD", rng.choice(["ab", "ba", "aa", "b", "[R", " "])), ("REGEX", rng.choice(["a+b", "(b+)+", ".*.*", "[ab]{2}", "("]))]), rng.choice(["MASK", "MASK", "AUDIT", "BLOCK_DOC", "BLOCK_SEARCH"]), rng.choice(["", "*", "ba"]), priority=rng.randrange(3))
    for _ in range(300):
        rules = [make(i) for i in range(rng.randrange(6))]
        texts = ["".join(rng.choice("ab [R") for _ in range(rng.randrange(12))) for _ in range(5)] + [None]
        for text, got in zip(texts, P.Screen(rules).run(texts), strict=True):
            out, hits, blocked = text or "", [], False
            for p in sorted(rules, key=lambda p: (-p.priority, p.id)):
                rx = P.safe_regex(p.value) if p.kind == "REGEX" else None
                n = (len(rx.findall(out)) if rx else 0) if p.kind == "REGEX" else P.occurrences(out, p.value) if p.value.strip() else 0
                if n:
                    hits.append((p.id, n))
                    if p.action == "BLOCK_DOC":
                        out, blocked = "", True
                        break
                    if p.action == "MASK":
                        put = p.replacement or "[REDACTED]"
                        out = rx.sub(lambda m: put, out) if rx else out.replace(p.value, put)
            assert got == (out, blocked, hits)


def test_parsers(spark):
    assert outline("<nav>x</nav><h2>T &amp; U</h2><p>a<b>b</b></p><ul><li>1<li>2</ul><script>z</script>") == "## T & U\nab\n1\n2"
    import io

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = f'<w:document {w}><w:body>{p("Title", "Heading1")}{p("text")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", body)
    assert docx_outline(f.getvalue()) == "# Title\ntext\n| a | b |"
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(f.getvalue()),), (bytearray("文本".encode()),), (bytearray(b"\x00\x01\x02"),)], "c binary")
    assert [r[0] for r in rows.select(file_kind(F.col("c"))).collect()] == ["pdf", "zip", "text", None]


def test_search_pieces(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, None)], "id int, v array<double>")
    assert [r[0] for r in v.select(S.vector_gate(F.col("v"), 2)).collect()] == [None, "dense_vector_zero_norm", "dense_vector_dim_mismatch", "dense_vector_invalid_value", "dense_vector_dim_mismatch"]
    assert S.adaptive_weights(0, 1.0, 0.1) == pytest.approx((0.12, 0.42)) and S.adaptive_weights(5, 9.0, 0.0, navigational=True) == (0.7, 0.3)
    assert V.nearest_rank is not None
    r = spark.createDataFrame([(1, "x", 1, True), (1, "x", 2, False), (2, "y", 1, False)], "k int, source string, doc_version int, is_latest boolean")
    assert [tuple(x) for x in V.stuck(r).collect()] == [("y", 1)]


def test_similar_documents_answers_every_query(spark, monkeypatch):
    import numpy as np

    from foliant.plans import registry, retrieval  # noqa: F401  registration comes first

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    x = np.random.default_rng(3).standard_normal((1000, 6))
    x[700:710] = x[50]  # equal scores
    e = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {}
    for r in retrieval.nearest_of_other_labels(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1000, 50):
        s = np.round(unit @ unit[q], 12)
        best = sorted((i for i in range(1000) if i % 3 != q % 3), key=lambda i: (-s[i], i))[:3]
        want[q] = [(n + 1, i, round(float(s[i]), 6)) for n, i in enumerate(best)]
    assert {q: [(n, i) for n, i, _ in v] for q, v in got.items() if q != 50} == {q: [(n, i) for n, i, _ in v] for q, v in want.items() if q != 50}
    assert len(got[50]) == 3 and all(abs(a[2] - b[2]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_cover_fills_up_to_the_limit(spark):
    import random

    from foliant.operators.evidence import cover

    rng = random.Random(5)
    terms = ["aa", "bb", "cc"]
    rows = [(c, t, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"][c % 4 :], k=rng.randint(1, 3))), float(rng.randint(1, 4))) for c in range(12) for t in range(9)]
    rows += [(90, t, "none", 1.0) for t in range(5)] + [(91, t, "aa", float(t)) for t in range(5)]
    want = set()
    for c in {r[0] for r in rows}:
        left, have = [r for r in rows if r[0] == c], set()
        for place in range(1, 4):
            best = min(left, key=lambda r: (-len((set(r[2].split()) & set(terms)) - have), -r[3], r[1]))
            left.remove(best)
            new = (set(best[2].split()) & set(terms)) - have
            want.add((c, place, best[1], len(new)))
            have |= new
    df = spark.createDataFrame(rows, "conv_id int, turn long, text string, score double")
    assert {tuple(r) for r in cover(df, terms, "conv_id").collect()} == want
