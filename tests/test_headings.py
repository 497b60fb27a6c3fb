from foliant.operators import headings as H

NOTICE = """关于加强管理的通知
政发〔2024〕15号

各县区人民政府：
2024年3月1日

总体要求

全面落实各项任务。
继续推进

一、工作目标
完成年度计划。
（一）重点任务
1.摸底排查
各单位要认真核查。
2024.5平方公里不是标题
（二）保障措施
一是加强领导
二是严格考核
| 单位 | 数量 |
|---|---|
| 甲 | 3 |
| 乙 | - |

附件1：名单
（一）甲组
说明文字
# 附录
第38页 共40页
令第9号"""


def test_notice_by_hand():
    got = [(b.kind, "/".join(b.path), b.text) for b in H.blocks(NOTICE)]
    assert got == [
        ("body", "", "关于加强管理的通知"),
        ("body", "", "政发〔2024〕15号\n各县区人民政府：\n2024年3月1日"),
        ("body", "总体要求", "总体要求"),
        ("body", "总体要求", "全面落实各项任务。\n继续推进"),
        ("body", "一、", "一、工作目标\n完成年度计划。"),
        ("body", "一、/（一）", "（一）重点任务"),
        ("body", "一、/（一）/1.", "1.摸底排查\n各单位要认真核查。\n2024.5平方公里不是标题"),
        ("body", "一、/（二）", "（二）保障措施"),
        ("body", "一、/一是加", "一是加强领导"),
        ("body", "一、/二是严", "二是严格考核"),
        ("table", "一、/二是严", "[表格数据] 单位为甲，数量为3。 单位为乙。"),
        ("body", "附件1：名单", "附件1：名单\n（一）甲组\n说明文字"),  # six characters after a blank line; in an annex nothing deepens the path
        ("body", "附录", "# 附录\n第38页 共40页"),
        ("doc_num", "", "令第9号"),
    ]


def test_naked_headings():
    yes = ["工作目标", "指导思想", "一年来的主要工作情况", "附则"]
    no = ["继续推进", "根据有关规定", "完成了任务目标吗？", "（内部资料）", "2024年3月", "通知如下", "这是一个没有标题词尾的普通句子啊", "x", "很长" * 11, "看过了"]
    assert [t for t in yes if not H.naked_heading(t, True)] == [] and [t for t in no if H.naked_heading(t, True)] == []
    assert not H.naked_heading("工作目标", False)


def test_forms_and_paths():
    path = ("甲", "乙", "丙")
    want = {
        "**一、总则**": ("一、",), "**（一）范围**": ("甲", "（一）"), "**第一章总则**": ("第一章",), "**1.细则**": ("1.",), "# A": ("A",), "## B": ("甲", "B"), "### C": ("甲", "乙", "C"), "#### D": ("甲", "乙", "D"),
        "第二章 总则": ("第二章",), "二、": ("二、",), "（二）x": ("甲", "（二）"), "(二)x": ("甲", "(二)"), "3.x": ("甲", "乙", "3."), "3、x": ("甲", "乙", "3、"), "三是强化": ("甲", "三是强"),
    }
    assert {k: H.heading_path(k, path) for k in want} == want
    assert H.heading_path("3.5 x", path) is None and H.heading_path("3.x", ()) == ("3.",) and H.heading_path("#x", path) is None


def test_tables_persons_and_empty():
    rows = [f"| 名{i} | {i} |" for i in range(45)]
    flat = H.flat_table(["| 名 | 数 |", "|--|--|", *rows])
    assert len(flat) == 3 and flat[0].startswith("[表格数据] 名为名0，数为0。 ") and flat[1].startswith("[表格数据第2组] 名为名20，") and flat[2].count("。") == 5
    assert H.flat_table(["|a|", "|b|"]) == ["|a| |b|"] and H.flat_table(["|a|", "|-|", "| - |"]) == ["[表格数据] | - |"] and H.flat_table(["|a|", "|-|", "|x|y|"]) == ["[表格数据] a为x，第2项为y。"]
    got = H.blocks("公示内容很长很长的一段说明文字啊啊啊啊\n姓名：甲，任职情况\n性别：男\n姓名：乙，任职情况\n说明\n| 一行 |", ("姓名",))
    assert [b.text for b in got] == ["公示内容很长很长的一段说明文字啊啊啊啊", "姓名：甲，任职情况\n性别：男", "姓名：乙，任职情况\n说明", "[表格说明: 说明]\n| 一行 |"]
    assert H.blocks(None) == H.blocks("") == H.blocks(" \n\n") == []
    assert [b.text for b in H.blocks("令第1号\n令第2号\n正文内容是一个完整的句子。")] == ["令第2号\n正文内容是一个完整的句子。"]


def test_context_stack(spark):
    rows = [("1.1.1 深处", "text"), ("1.2 次级", "text"), ("正文", "text"), ("第一章 总则", "text"), ("## 小节", "title"), ("### 细目", "title"), ("正文", "text"), ("## ", "title"), ("尾", "text"), ("标题", "title")]
    want = [["深处"], ["深处", "次级"], ["深处", "次级"], ["总则"], ["总则", "小节"], ["总则", "小节", "细目"], ["总则", "小节", "细目"], ["总则"], ["总则"], ["标题"]]
    assert H.context_stacks(rows) == want
    df = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate(rows)] + [(2, 0, None, "title")], "doc int, n int, text string, kind string").repartition(3)
    got = {(r.doc, r.n): r.context for r in H.element_contexts(df, "doc", "n", "text", "kind").collect()}
    assert got == {**{(1, i): f"[Context: {' > '.join(s)}] " for i, s in enumerate(want)}, (2, 0): ""}


def test_whole_documents(spark):
    docs = spark.createDataFrame([(1, NOTICE), (2, None), (3, "段落文字。\n" * 50_000)], "doc_id int, text string")
    rows = H.document_blocks(docs).collect()
    assert [(r.kind, r.path, r.content) for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.n)] == [(b.kind, "/".join(b.path), b.text) for b in H.blocks(NOTICE)]
    assert sum(len(r.content) for r in rows if r.doc_id == 3) >= 250_000 and not [r for r in rows if r.doc_id == 2]
