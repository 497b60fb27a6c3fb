"""Evidence for answers: pairs, grouping, ranking, packing, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens


def qa_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn directly followed by an assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def group_evidence(hits: DataFrame, doc: str) -> DataFrame:
    """Hits (doc, chunk_index, score) by document: number, best and summed score, chunk numbers in order."""
    return hits.groupBy(doc).agg(F.count(F.lit(1)).alias("hit_count"), F.max("score").alias("max_score"), F.sum("score").alias("sum_score"), F.array_sort(F.collect_list("chunk_index")).alias("chunks"))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def rank_evidence(hits: DataFrame, terms: list[str], doc: str) -> DataFrame:
    """Documents ranked by 1.5 best + ln(1 + sum) + 0.4 hits + 2 coverage + 0.8 adjacent chunks."""
    q = F.array(*[F.lit(t) for t in terms])
    prev = F.lag("chunk_index").over(Window.partitionBy(doc).orderBy("chunk_index"))
    h = hits.withColumns({"adjacent": F.when(F.col("chunk_index") - prev == 1, 1).otherwise(0), "cov": F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), q)) / float(len(terms))})
    score = 1.5 * F.max("score") + F.log(1 + F.sum("score")) + 0.4 * F.count(F.lit(1)) + 2 * F.max("cov") + 0.8 * F.sum("adjacent")
    return h.groupBy(doc).agg(score.alias("rank_score"))


def pack(rows: DataFrame, part: list[str], order: str, budget: int, least: int = 120) -> DataFrame:
    """Rows with ``size`` packed in order into a budget of characters; the last is cut when ``least`` remain."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("used", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("take", F.least(F.col("size"), F.lit(budget) - F.col("used")))
    return out.where((F.col("take") == F.col("size")) | (F.lit(budget) - F.col("used") >= least))


def unknown_citations(answer: Column, known: int, pattern: str = r"\[(\d+)\]", group: int = 1) -> Column:
    """Distinct citation numbers of an answer that aren't 1 to ``known``."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(group)), lambda x: x.try_cast("long")))
    return F.filter(cited, lambda x: x.isNull() | (x < 1) | (x > known))


def cover(hits: DataFrame, terms: list[str], doc: str, most: int = 3) -> DataFrame:
    """Greedy cover: per document up to ``most`` chunks by newly covered terms, then score, then order.

    When no chunk adds a term, places are filled by score.  A term is a bit of a number; of each document and bit set
    only the best ``most`` chunks can be chosen, so a group is at most most * 2 ** len(terms) rows.
    """
    bits = sum((F.when(F.array_contains("t", t), 1 << i).otherwise(0) for i, t in enumerate(terms)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(doc, "bits").orderBy(F.desc("score"), "turn"))
    sets = hits.withColumn("t", tokens(F.col("text"))).withColumn("bits", bits).select(doc, "bits", "turn", "score").withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        have, out, left = 0, [], pdf.sort_values(["score", "turn"], ascending=[False, True]).to_dict("records")
        while left and len(out) < most:
            best = max(left, key=lambda r: (bin(r["bits"] & ~have).count("1"), r["score"], -r["turn"]))
            left.remove(best)
            out.append((best[doc], len(out) + 1, best["turn"], bin(best["bits"] & ~have).count("1")))
            have |= best["bits"]
        return pd.DataFrame(out, columns=[doc, "place", "turn", "gain"])

    kind = hits.schema[doc].dataType.simpleString()
    return sets.groupBy(doc).applyInPandas(choose, f"{doc} {kind}, place int, turn long, gain int")
