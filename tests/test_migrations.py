import pytest
from pyspark.sql import functions as F

from foliant.operators import migrations as M


def test_codes(spark):
    rows = [" a, b ,,a", '["x", " y ", "x", null, 3]', "[broken", None, "", "甲，乙", "[]"]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select(M.codes(F.col("c")).alias("n"), M.codes(F.col("c"), wide=True).alias("w")).collect()
    assert [r.n for r in got] == [["a", "b"], ["x", "y", "3"], ["[broken"], [], [], ["甲，乙"], []] and got[5].w == ["甲", "乙"]


def test_backfill(spark):
    schema = "id int, source_index string, index_code string, owner_unit_code string, visible_unit_codes array<string>, acl_tokens array<string>, meta_acl_tokens array<string>, visibility string, meta_visibility string"
    full = ("i", "c", "o", ["g"])
    rows = [(1, *full, ["t"], None, None, None), (2, *full, None, ["m"], "PUBLIC", None), (3, *full, None, None, " public", None), (4, *full, None, None, None, None), (5, *full, None, [], "", "GRANT"), (6, None, "c", "o", ["g"], ["own"], None, "PUBLIC", None), (7, "i", "c", "o", None, [], None, None, "INTERNAL")]
    df = spark.createDataFrame(rows, schema).withColumn("permission_version", F.lit(1))
    got = {r.id: (r.filled, r.acl_tokens) for r in M.backfill_tokens(df).collect()}
    assert got == {1: (False, ["t"]), 2: (True, ["m"]), 3: (True, ["_PUBLIC"]), 4: (True, ["_INTERNAL"]), 5: (True, ["_NO_ACCESS"]), 6: (True, ["own"]), 7: (True, ["_INTERNAL"])}
    dry = {r.id: (r.filled, r.acl_tokens) for r in M.backfill_tokens(df, execute=False).collect()}
    assert dry[3] == (True, None) and dry[1] == (False, ["t"])


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"source_name":" a ","acl_tokens":["t1","t1"],"permission_version":7}\n\n{"source":"b","dept_code":"62","acl_tokens":"","visible_unit_codes":"62, 6201","permission_version":"x"}\n{"source_name":"","source":""}\n{"source_name":"a","acl_tokens":"t2,t3","owner_unit_code":"o"}\n')
    records = M.snapshot_records(M.read_snapshot(spark, str(tmp_path)), F.lit(99).cast("long"))
    got = {r.source_name: (r.acl_tokens, r.owner_unit_code, r.visible_unit_codes, r.permission_version) for r in records.collect()}
    assert got == {"a": (["t2", "t3"], "o", ["o"], 99), "b": (["_NO_ACCESS"], "62", ["62", "6201"], 99)}
    rows = spark.createDataFrame([(1, "a", ["old"], "x", ["x"], 1), (2, "c", ["old"], "x", ["x"], 1), (3, None, None, None, None, None)], "id int, src string, acl_tokens array<string>, owner_unit_code string, visible_unit_codes array<string>, permission_version long")
    out = {r.id: (r.updated, r.acl_tokens, r.owner_unit_code, r.permission_version) for r in M.apply_snapshot(rows, records, "src").collect()}
    assert out == {1: (True, ["t2", "t3"], "o", 99), 2: (False, ["old"], "x", 1), 3: (False, None, None, None)}
    (tmp_path / "t.jsonl").write_text("not json\n")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        M.read_snapshot(spark, str(tmp_path)).collect()


def test_second_form_and_audit(spark):
    text = "content string, display_content string, chunk_granularity string, parent_chunk_id string, keywords string, acl_tokens string, visible_unit_codes string, source_index string, index_code string, owner_unit_code string, permission_version string"
    meta = "meta struct<acl_tokens:string,visible_unit_codes:string,source_index:string,index_code:string,owner_unit_code:string,permission_version:string>"
    rows = [(1, "c", None, "fine", None, "k1，k2", "a,b", None, " ", None, "o", "12", ("m", "v", "mi", None, None, "5")), (2, *[None] * 11, None), (3, *[None] * 5, " ", "", None, "code", None, "x", ("m1,m1", None, None, None, "mo", "6"))]
    out = {r.id: r for r in M.second_form(spark.createDataFrame(rows, f"id int, {text}, {meta}"), "target", F.lit(99).cast("long")).collect()}
    pick = lambda r: (r.content, r.display_content, r.keywords, r.acl_tokens, r.source_index, r.index_code, r.owner_unit_code, r.visible_unit_codes, r.permission_version)
    assert pick(out[1]) == ("c", "", ["k1", "k2"], ["a", "b"], "mi", "mi", "o", ["v"], 12)
    assert pick(out[2]) == ("", "", [], ["_NO_ACCESS"], "target", "target", "global", ["global"], 99)
    assert pick(out[3]) == ("", "", [], ["m1"], "target", "code", "mo", ["global"], 99)
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert tuple(M.audit(a, b, "id").first()) == (3, 2, 1, 1) and tuple(M.audit(a.limit(0), b.limit(0), "id").first()) == (0, 0, 0, 0)
