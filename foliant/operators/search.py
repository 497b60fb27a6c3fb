"""Retrieval and ranking: BM25, exact nearest neighbours, sparse features, rank fusion, collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.sources.tables import spread

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(id, term, tf); with ``terms`` only theirs, filtered before anything is shuffled."""
    t = docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("term"))
    if terms is not None:
        t = t.where(F.col("term").isin(*terms))
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def term_counts(text: Column, terms: list[str]) -> Column:
    """How often each of a few terms is among a text's tokens, in the terms' order; nothing is split or exploded."""
    low = F.lower(text)
    # the pattern starts with the term itself, which the JVM looks for as a literal
    each = [F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(f"{w}(?<![a-z0-9]{w})(?![a-z0-9])"))).otherwise(0) for w in terms]
    return F.array(*each)


def bm25_stats(counted: DataFrame, terms: list[str]) -> DataFrame:
    """One row: number of rows (len, tf), their mean length, and for each term the rows that hold it."""
    held = [F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(terms))]
    return counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), F.array(*held).alias("df"))


def bm25_score() -> Column:
    """Score of a row (len, tf) beside the one row of ``bm25_stats``."""
    idf = F.transform("df", lambda d: F.log(1 + (F.col("n_docs") - d + 0.5) / (d + 0.5)))
    part = F.zip_with("tf", idf, lambda f, w: w * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))))
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x)


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the rows that hold any of the terms, every row a document.

    Statistics are one row, from one aggregate; scores are a projection beside it, and nothing else is shuffled.
    """
    counted = spread(docs.select(id_col, text_col)).select(id_col, token_count(F.col(text_col)).alias("len"), term_counts(F.col(text_col), terms).alias("tf"))
    hits = counted.where(F.exists("tf", lambda f: f > 0))
    return hits.crossJoin(F.broadcast(bm25_stats(counted, terms))).select(id_col, bm25_score().alias("score"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, cf): rows that hold a term and its occurrences, combined before the shuffle."""
    t = spread(docs.select(text_col)).select(tokens(F.col(text_col)).alias("t"))
    each = F.concat(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))
    return t.select(F.explode(each).alias("e")).groupBy("e.term").agg(F.sum("e.d").alias("df"), F.sum("e.c").alias("cf"))


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows with their rank; ties to the smaller id."""
    best = scored.orderBy(F.desc(score), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None) -> DataFrame:
    """Exact cosine top-k for one query vector; a projection and a top-k, no shuffle of the vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, cosine(F.col(vec_col), q).alias("score"))
    return top_k(scored if least is None else scored.where(F.col("score") >= least), k, id_col)


def sparse_scores(features: DataFrame, query: dict[str, float], id_col: str = "doc_id", most: int = 16) -> DataFrame:
    """(id, token, weight) features against the query's heaviest tokens with saturation weight / (weight + pivot)."""
    best = dict(sorted(query.items(), key=lambda x: (-x[1], x[0]))[:most])
    pivot = F.create_map(*[F.lit(v) for kv in best.items() for v in kv])[F.col("token")]
    hits = features.where(F.col("token").isin(*best))
    return hits.groupBy(id_col).agg(F.sum(F.col("weight") / (F.col("weight") + pivot)).alias("score"))


def fuse(channels: dict[str, tuple[DataFrame, float]], id_col: str = "doc_id", k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked channels (id, rank): (id, rrf, channels)."""
    parts = [df.select(id_col, "rank", F.lit(name).alias("channel"), F.lit(float(w)).alias("w")) for name, (df, w) in channels.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(id_col).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("channel")).alias("channels"))


def adaptive_weights(bm25_hits: int, top_ratio: float, knn_top: float, cfg_text: float = 0.3, cfg_knn: float = 0.7, navigational: bool = False) -> tuple[float, float]:
    """Weights of the text and vector channels from how sure each of them is."""
    if navigational:
        return max(cfg_text, 0.7), min(cfg_knn, 0.3)
    text = min(0.2 + (top_ratio - 1) / 8 * 0.8, 1.0) if bm25_hits else 0.0
    vector = max(0.0, min(1.0, knn_top))
    total = text + vector
    if total < 0.2:
        return cfg_text * 0.4, cfg_knn * 0.6
    return cfg_text * (text / total * 0.6 + 0.2), cfg_knn * (vector / total * 0.6 + 0.2)


def final_score(es: Column, knn: Column, rerank: Column, rrf: Column, base: float = 150.0) -> Column:
    lexical = es / (es + base)
    return F.greatest(F.when(knn > 0, F.greatest(knn, lexical)).otherwise(lexical), F.coalesce(rerank, F.lit(0.0)), rrf * 10)


def compressed(score: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.pow(score, F.lit(1.8))))


def similarity_label(c: Column, high: float = 0.85, mid: float = 0.70, low: float = 0.55) -> Column:
    return F.when(c >= high, "HIGH").when(c >= mid, "MEDIUM").when(c >= low, "LOW").otherwise("NONE")


def cosine_histogram(scores: DataFrame, col: str = "score", bins: int = 5) -> DataFrame:
    """Counts of clamp(int(bins * score), 0, bins - 1)."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(col) * bins).cast("int")))
    return scores.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def collapse(hits: DataFrame, doc_col: str, score: str = "score", order: list[Column] | None = None, most: int = 5) -> DataFrame:
    """At most ``most`` rows of each document, best first, with the document's best score."""
    w = Window.partitionBy(doc_col).orderBy(*(order or [F.desc(score)]))
    return hits.withColumn("nth", F.row_number().over(w)).withColumn("doc_score", F.max(score).over(Window.partitionBy(doc_col))).where(F.col("nth") <= most)


def hold_all_terms(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents whose tokens hold every term, in any of a document's rows."""
    hit = postings(docs, id_col, text_col, terms)
    return hit.groupBy(id_col).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms))).select(id_col)


def mean_pool(vectors: DataFrame, key: str, vec_col: str = "embedding", unit: bool = True) -> DataFrame:
    """Mean vector of each key, scaled to length 1: averages per position, so that a hot key is combined before the shuffle."""
    means = vectors.select(key, F.posexplode(vec_col).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    size = norm(F.col("vector"))
    return pooled.withColumn("vector", F.when(size > 0, F.transform("vector", lambda x: x / size)).otherwise(F.col("vector"))) if unit else pooled


def vector_gate(vec: Column, dims: int, least_norm: float = 1e-8) -> Column:
    """Why a vector may not be indexed, or null."""
    return (
        F.when(vec.isNull() | (F.size(vec) != dims), "dense_vector_dim_mismatch")
        .when(~F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "dense_vector_invalid_value")
        .when(norm(vec) <= least_norm, "dense_vector_zero_norm")
    )


def keyword_rank(best: Column, coverage: Column, one_chunk_covers: Column, metadata_hits: Column) -> Column:
    return best + 5 * coverage + F.when(one_chunk_covers, 8).otherwise(0) + 3 * metadata_hits
