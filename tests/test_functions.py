from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.unicode import clean_content, clean_filename, clean_metadata, normalize_filename


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_percent_decoding():
    assert clean_filename("%E6%B0%91%E6%B3%95%E5%85%B8+A.docx") == "民法典+A.docx"
    assert clean_metadata("%E8%A1%8C%E6%94%BF%E5%A4%84%E7%BD%9A%E5%86%B3%E5%AE%9A%E4%B9%A6") == "行政处罚决定书"
    assert clean_metadata("完成率 95%") == "完成率 95%"
    assert clean_content("%E6%B0%91%E6%B3%95") == "民法"
    url = "见 http://a/%E6%B0%91 一文"
    assert clean_content(url) == url
    assert clean_filename(None) == "" and clean_filename("a/b:c?.txt") == "a_b_c_.txt" and len(clean_filename("x" * 300)) == 200


def test_udf_form(spark):
    assert one(spark, normalize_filename("a"), a="%E6%B0%91.pdf") == "民.pdf"


def test_scalars(spark):
    a = F.col("a")
    assert one(spark, T.half_width(a), a="ＡＢ１　？") == "AB1 ?"
    assert one(spark, T.strip(a), a="　\t x \n") == "x"
    assert one(spark, T.cjk_count(a), a="ab民法c") == 2
    assert one(spark, T.has_encoded_chinese(a), a="%E6%B0%91") is True
    assert one(spark, T.normalize_list(F.split(a, ",")), a=" b,a,b,, c") == ["b", "a", "c"]
    assert one(spark, T.department_code(a), a="620102000000") == "620102" and one(spark, T.department_code(a), a="100") == "1"
    assert one(spark, T.index_code(a), a="kb_document_policy_v2_write") == "policy"
    assert one(spark, T.required_terms(a), a=" a　b a ") == ["a", "b"]
    assert one(spark, T.ngrams(a, 2, 3), a="AbC") == ["ab", "bc", "abc"]
    assert one(spark, T.ngram_overlap(a, F.col("b"), 2), a="abcd", b="xxbcx") == 1 / 3
    assert one(spark, T.document_of(T.chunk_id(a, F.lit(3), F.lit(7))), a="x") == one(spark, F.md5(a), a="x")
    assert one(spark, T.snippet(a, F.lit("Hit"), 2, 3), a="abcdhitefgh") == "...cdhitefg..."
    assert one(spark, T.dynamic_meta(a, {"no": r"〔(\d{4})〕", "x": "(zzz)"}), a="甘政发〔2024〕1号") == {"no": "2024"}
    assert [one(spark, T.query_intent(a), a=q) for q in ("有哪些材料", "如何办理", "需要多少钱", "谁负责")] == ["LIST", "PROCEDURE", "COUNT_OR_TIME", "FACT"]
    assert one(spark, T.html_text(a), a="<p>a &amp; b</p><script>x</script><td> c </td>") == "a & b\nc"


def test_content_hash_levels(spark):
    import hashlib

    row = spark.createDataFrame([("", bytearray(b"z" * 9000), "t"), ("given", None, "t"), (None, None, "t" * 3000)], "g string, c binary, t string")
    got = [r[0] for r in row.select(T.content_hash(F.col("g"), F.col("c"), F.col("t"))).collect()]
    assert got == [hashlib.sha256(b"z" * 8192).hexdigest(), "given", hashlib.sha256(b"t" * 2000).hexdigest()]
