"""Ranking rules after recall: channel weights, demotions, vetoes, boosts and final scores as column expressions and small windows.

Candidates are rows of one query (or document) key; a window over that key sees at most what recall let through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators.cosines import best_by_group, by_blocks
from foliant.operators.search import postings
from foliant.sources.tables import spread

#: Factors on the question-answer channel by intent, and on preambles by document type.
QA_FACTORS, QA_OTHERWISE = {"INFORMATIONAL": 1.5, "NAVIGATIONAL": 0.3}, 0.8
PREAMBLE_FACTORS, PREAMBLE_OTHERWISE = {"公示": 0.25, "通知": 0.40, "通告": 0.40}, 0.55
DENSE_TYPES = ("公示", "法规")
#: Query tokens broadcast at once.
QUERY_BLOCK = 1_000


def _by(value: Column, factors: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, factor in factors.items():
        out = F.when(value == name, factor).otherwise(out)
    return out


def channel_weights(hits: Column, ratio: Column, knn_top: Column, navigational: Column, intent: Column, cfg_text: float = 0.3, cfg_knn: float = 0.7) -> Column:
    """struct(text, vector, sparse, qa, prefilter): how much each recall channel counts in the fusion of a query."""
    text = F.when(hits > 0, F.least(0.2 + (ratio - 1) / 8 * 0.8, F.lit(1.0))).otherwise(0.0)
    vector = F.greatest(F.lit(0.0), F.least(F.lit(1.0), knn_top))
    share = lambda x: x / (text + vector) * 0.6 + 0.2
    unsure = text + vector < 0.2
    return F.struct(
        F.when(navigational, max(cfg_text, 0.7)).when(unsure, cfg_text * 0.4).otherwise(cfg_text * share(text)).alias("text"),
        F.when(navigational, min(cfg_knn, 0.3)).when(unsure, cfg_knn * 0.6).otherwise(cfg_knn * share(vector)).alias("vector"),
        F.lit(0.2 * cfg_text).alias("sparse"), (cfg_knn * _by(intent, QA_FACTORS, QA_OTHERWISE)).alias("qa"), F.lit(max(cfg_text, 1.0) * 2).alias("prefilter"),
    )


def suppress_weak_text(found: DataFrame, query: str, es: str = "es", knn: str = "knn", rrf: str = "rrf") -> DataFrame:
    """Where no candidate of a query has a text score of 2, those without a vector signal keep 5 % of their fused score."""
    best = F.max(es).over(Window.partitionBy(query))
    return found.withColumn(rrf, F.when((best < 2.0) & (F.coalesce(F.col(knn), F.lit(0.0)) < 0.15), F.col(rrf) * 0.05).otherwise(F.col(rrf)))


def preamble_factor(doc_type: Column, flagged: Column, path: Column, content: Column) -> Column:
    """Factor on the fused score of introductions: flagged ones, and unplaced chunks whose first 200 characters read like one."""
    head = F.substring(content, 1, 200)
    has = lambda *words: F.coalesce(_all([F.contains(head, F.lit(w)) for w in words]), F.lit(False))
    like = (has("根据") & (has("规定") | has("条例"))) | has("经", "研究决定") | has("特此通知") | has("特此公示") | has("现将", "公示")
    unplaced = F.coalesce(path, F.lit("")).isin("", "null")
    return F.when(F.coalesce(flagged, F.lit(False)) | (unplaced & like), _by(F.coalesce(doc_type, F.lit("")), PREAMBLE_FACTORS, PREAMBLE_OTHERWISE)).otherwise(1.0)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def surviving(found: DataFrame, query: str, score: str = "score", rerank: str = "rerank", veto: float = 0.6, corpus: float = 0.35, floor: float = 0.15) -> DataFrame:
    """Candidates that stay: none of a query of five or more that all rerank under the veto, or whose best score is under the
    corpus threshold; else those of at least a fifth of the best score and the floor, or of .99."""
    w = Window.partitionBy(query)
    vetoed = (F.count(rerank).over(w) >= 5) & (F.max(rerank).over(w) < veto)
    top = F.max(score).over(w)
    out = found.withColumns({"_gone": F.coalesce(vetoed, F.lit(False)) | (top < corpus), "_least": F.greatest(top * 0.2, F.lit(floor))})
    return out.where(~F.col("_gone") & ((F.col(score) >= F.col("_least")) | (F.col(score) >= 0.99))).drop("_gone", "_least")


def baseline_score(qa: Column, rerank: Column, es_norm: Column, es: Column, knn: Column, rrf: Column) -> Column:
    """Formula score of a candidate: question-answer hits, reranked ones, else text or vector evidence."""
    plain = rerank.between(0.0, 1.0)
    relevance = F.when(plain, rerank).otherwise(1 / (1 + F.exp(-rerank)))
    ranked = F.when(relevance < F.when(plain, 0.60).otherwise(0.10), 0.0001).otherwise(relevance * 0.9 + es_norm * 0.1)
    return F.when(qa, 0.95).when(rerank.isNotNull(), ranked).when(es > 1.0, F.greatest(es_norm, rrf * 5)).when(knn >= 0.65, knn * 0.7).otherwise(0.0001)


def boost_densest(found: DataFrame, doc: str, order: str, density: str = "density", rrf: str = "rrf", kind: str = "doc_type") -> DataFrame:
    """In documents of some types with several candidates the densest (the first of equals) gets 1.3 times its score, nine tenths of the best at least."""
    w = Window.partitionBy(doc)
    first = F.row_number().over(w.orderBy(F.desc(density), order)) == 1
    best = F.max(rrf).over(w)
    boosted = first & (F.count(F.lit(1)).over(w) > 1) & F.col(kind).isin(*DENSE_TYPES) & (best > 0)
    return found.withColumn(rrf, F.when(boosted, F.greatest(F.col(rrf) * 1.3, best * 0.9)).otherwise(F.col(rrf)))


def shown_score(rank: Column, top: Column) -> Column:
    """The score that a keyword result shows."""
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), 0.5 + 0.49 * rank / top)), 4)


def _shown_weight(w: Column) -> Column:
    """Four places; a value within one double of a half goes up, as the half itself."""
    return F.round(w * 10_000) / 10_000


def sparse_weights(features: DataFrame, id_col: str = "doc_id", token: str = "token", weight: str = "weight", most: int = 64) -> DataFrame:
    """(id, token, weight): weights from the median up, scaled to .1 to 1 (all .5 where they are equal), a token's largest, the best ``most``."""
    w = Window.partitionBy(id_col)
    middle, top = F.median(weight).over(w), F.max(weight).over(w)
    scaled = F.when(top > middle, F.when(F.col(weight) >= middle, 0.1 + 0.9 * (F.col(weight) - middle) / (top - middle))).otherwise(0.5)
    kept = features.withColumn("_w", scaled).where("_w > 0").groupBy(id_col, token).agg(F.max("_w").alias("_w"))
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("_w"), token))
    return kept.withColumn("_n", nth).where(F.col("_n") <= most).select(id_col, token, _shown_weight(F.col("_w")).alias(weight))


def sparse_encoding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 64) -> DataFrame:
    """(id, token, weight) as ``sparse_weights`` of the postings, each row by itself: nothing is hashed, sorted or shuffled beyond a row.

    Only rows of an id that occurs more than once go through ``sparse_weights``.
    """
    held = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  a value that lambdas use, made once a row

    def counted(t: Column) -> Column:
        """(token, n) of sorted tokens: from where each begins to where the next one does."""
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i] != t[F.greatest(i - 1, F.lit(0))]))
        return held(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(t))), lambda at, end: F.struct(t[at].alias("token"), (end - at).cast("double").alias("n"))))

    def weighed(words: Column, n: Column) -> Column:
        middle, top = (n[F.floor((F.size(n) - 1) / 2).cast("int")] + n[F.floor(F.size(n) / 2).cast("int")]) / 2, n[F.size(n) - 1]
        bounds = F.struct(middle.alias("middle"), top.alias("top"))

        def each(b: Column) -> Column:
            scaled = lambda x: F.when(b["top"] > b["middle"], 0.1 + 0.9 * (x - b["middle"]) / (b["top"] - b["middle"])).otherwise(0.5)
            kept = F.filter(words, lambda w: (b["top"] <= b["middle"]) | (w["n"] >= b["middle"]))
            return F.transform(kept, lambda w: F.struct((-scaled(w["n"])).alias("less"), w["token"].alias("token")))

        return F.slice(F.array_sort(held(bounds, each)), 1, most)

    def alone(rows: DataFrame) -> DataFrame:
        t = spread(rows.select(id_col, text_col)).select(id_col, F.array_sort(tokens(F.col(text_col))).alias("_t")).where(F.size("_t") > 0)
        best = held(F.col("_t"), lambda t: held(counted(t), lambda words: held(F.array_sort(F.transform(words, lambda w: w["n"])), lambda n: weighed(words, n))))
        return t.select(id_col, F.explode(best).alias("_w")).select(id_col, "_w.token", _shown_weight(-F.col("_w.less")).alias("weight"))

    repeated = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    if repeated.isEmpty():
        return alone(docs)
    same = docs[id_col].eqNullSafe(repeated["_id"])
    together = postings(docs.join(repeated, same, "left_semi"), id_col, text_col).select(id_col, F.col("term").alias("token"), F.col("tf").cast("double").alias("weight"))
    return alone(docs.join(repeated, same, "left_anti")).unionByName(sparse_weights(together, id_col, most=most))


def late_interaction(tokens: DataFrame, queries: DataFrame, doc: str, vec: str = "embedding", query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(doc, score): mean over query tokens of the largest cosine with any token of the document.

    Query tokens go out in blocks of about ``QUERY_BLOCK``, each against all document tokens, as products of matrices in tasks;
    one row a task, document and query token is all that moves.
    """

    def answer(rows: DataFrame, asked: pa.Table) -> DataFrame:
        best = best_by_group(rows, asked, doc, vec, query_id, query_vec).groupBy(doc, query_id).agg(F.max("best").alias("best"))
        return best.groupBy(doc).agg(F.sum("best").alias("_sum"), F.count("best").alias("_n"))

    parts = by_blocks(tokens.select(doc, vec), queries.select(query_id, query_vec), query_id, QUERY_BLOCK, "late-interaction", answer)
    return parts.groupBy(doc).agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("score"))
