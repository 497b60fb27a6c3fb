import pandas as pd
from pyspark.sql import functions as F

from foliant.operators import chunking as C
from foliant.operators import policy as P
from foliant.operators.literals import Automaton
from foliant.sources import batches


def test_pieces_hold_at_most_so_many_characters():
    assert list(batches.pieces(["ab", None, "c" * 9, "", "d"], 5)) == [["ab", None], ["c" * 9], ["", "d"]]
    assert list(batches.pieces([])) == []


def test_screening_takes_few_characters_at_once(spark, monkeypatch):
    sizes, hits = [], Automaton.hits
    monkeypatch.setattr(Automaton, "hits", lambda self, texts: sizes.append(sum(map(len, texts))) or hits(self, texts))
    screen = P.apply_policies([P.Policy(1, "WORD", "cat", "MASK", "**")]).func
    (out,) = screen(iter([pd.Series(["the cat " + "x" * 2000, None] * 1500)]))
    assert out["text"].tolist() == ["the ** " + "x" * 2000, ""] * 1500 and out["hits"].sum() == 1500
    assert max(sizes) <= batches.PIECE < 3_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(batches.BATCH_BYTES)


def test_words_are_counted_piece_by_piece(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("the cat "), F.repeat(F.lit("x"), 2000))).alias("text"))
    got = P.word_counts(texts, ["cat", "t"], "id", "text").groupBy("word").agg(F.sum("hits").alias("n")).collect()
    assert {r.word: r.n for r in got} == {"cat": 1500, "t": 3000}


def test_links_where_chunks_are_made(spark, monkeypatch):
    """The same links as by grouping, with no shuffle; long documents by hashes, too."""
    texts = ["# A\n" + " ".join(f"Sentence {i % 7} of many words, {i}." for i in range(n)) for n in (0, 1, 40, 400)]
    texts += ["第一条 本办法适用于全部文件。\n第二条 本规定自公布之日起施行。\n" * 30, None, " \n ", "一是先行。二是后行。" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    want = sorted(C.link_parents(C.chunk_documents(docs)).collect())
    assert want and any(r.parent_chunk_id for r in want)
    got = C.linked_chunks(docs)
    assert sorted(got.collect(), key=tuple) == sorted(want, key=tuple) and got.columns == ["doc_id", "fine_id", "parent_chunk_id"]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    probes, wholes = ["b", "", "ca", "x"], ["ab", "bca"]
    assert C._first_coarse(probes, wholes) == [0, 0, 1, -1] and C._first_coarse(probes, []) == [-1] * 4
    monkeypatch.setattr(C, "MOST_LOOKED", 0)
    assert C._first_coarse(probes, wholes) == [0, 0, 1, -1]


def test_chunks_leave_piece_by_piece(spark):
    run = C._flat(lambda ident, source, text, kind: [(ident,)] * 3, ["id"])
    batch = pd.DataFrame({"id": range(10), "source": "s", "text": "x" * (batches.PIECE // 2), "doc_type": "t"})
    assert [len(p) for p in run(iter([batch]))] == [6, 6, 6, 6, 6, 0]
