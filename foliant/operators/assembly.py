"""What a search shows: terms of a question, snippets with marks, keyword results, when to rerank, what goes into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranking import shown_score

#: Characters before and after a term, of a snippet without one, chunks and literal score of a result.
BEFORE, AFTER, PLAIN, CHUNKS, LITERAL = 50, 90, 160, 3, 0.99
MARKS = ("<em class='highlight'>", "</em>")
#: Fixed values of reranking: short questions, frequent terms, flat scores, weak scores, candidates on slow machines and at most.
SHORT, FREQUENT, FLAT, WEAK, SLOW_MOST, MOST, MOST_SHOWN = 4, 50, 1.3, 1.0, 12, 30, 100
NOTICES = ("公示", "法规")
#: Fixed values of the common veto: share of candidates, least number.
VETO_SHARE, VETO_LEAST = 0.70, 5
#: Fixed values of enough evidence: for lists hits, structure and entities, else score and coverage; words that say nothing; words that ask for a list.
ENOUGH_LIST, ENOUGH = (3, 0.35, 0.25), (2.0, 0.15)
GENERIC = ("要求", "规定", "内容", "情况", "信息", "材料", "流程", "条件")
LISTING = ("哪些", "名单", "人员", "谁", "晋升", "提拔", "任命", "候选人", "多少人")


def strip_noise(question: Column, noise: list[str]) -> Column:
    """The question's words of two or more characters, noise words taken out of it in order; if none is left, the question."""
    left = question
    for word in filter(None, noise):
        left = F.replace(left, F.lit(word), F.lit(""))
    kept = F.array_join(F.filter(F.split(F.trim(left), r"\s+"), lambda w: F.length(w) >= 2), " ")
    return F.when(F.length(F.trim(question)) == 0, question).otherwise(F.when(kept == "", question).otherwise(kept))


def core_terms(question: Column, noise: list[str], letters: str = "一-龥") -> Column:
    """A short question itself (two to four characters), else its first three different runs of letters between noise words."""
    trimmed = F.trim(question)
    left = trimmed
    for word in filter(None, noise):
        left = F.replace(left, F.lit(word), F.lit(" "))
    runs = F.filter(F.split(F.trim(F.regexp_replace(left, f"[^{letters}]+", " ")), r"\s+"), lambda w: F.length(w) >= 2)
    none = F.array().cast("array<string>")
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) == 0, none).when(F.length(trimmed).between(2, 4), F.array(trimmed)).otherwise(F.slice(F.array_distinct(runs), 1, 3))


def snippet(content: Column, terms: Column) -> Column:
    """The surroundings of the term that a text holds first (of two at one place the earlier of the list), or its beginning."""
    held = F.filter(F.transform(terms, lambda t, i: F.struct(F.position(t, content).alias("at"), i.alias("nth"), F.length(t).alias("size"))), lambda x: x["at"] > 0)
    first = F.array_min(held)
    begin = F.greatest(first["at"] - 1 - BEFORE, F.lit(0))
    end = F.least(F.length(content), first["at"] - 1 + first["size"] + AFTER)
    around = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(content, begin + 1, end - begin), F.when(end < F.length(content), "...").otherwise(""))
    return F.when(F.size(held) > 0, around).otherwise(F.substring(content, 1, PLAIN))


def marked(text: Column, terms: Column) -> Column:
    """Every occurrence of every term between marks, the longest terms first; blank terms aren't marked."""
    longest = F.array_sort(F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
    return F.aggregate(longest, text, lambda out, x: F.replace(out, x["t"], F.concat(F.lit(MARKS[0]), x["t"], F.lit(MARKS[1]))))


def keyword_results(docs: DataFrame, chunks: DataFrame, literal: DataFrame, query: str, most: int) -> DataFrame:
    """(query, place, doc_id, file_name, organization, title, score, chunk_text, chunks) as shown, the best first.

    ``docs`` has (query, rank, doc_id, file_name, owner, title, summary, rank_score, terms): its first ``most`` by query are
    shown, scored against the first.  ``chunks`` has (query, doc_id, nth, chunk_id, content, terms): a document's first three
    are its snippets; without any, its summary, title or file name is.  ``literal`` hits (query, nth, doc_id, file_name, owner, title)
    of files that aren't shown come before all others.
    """
    top = docs.where(F.col("rank") <= most)
    best = F.max(F.when(F.col("rank") == 1, F.col("rank_score"))).over(Window.partitionBy(query))
    scored = top.withColumn("score", shown_score(F.col("rank_score"), F.when(best <= 0.001, 1.0).otherwise(best)))
    nth = F.row_number().over(Window.partitionBy(query, "doc_id").orderBy("nth", "chunk_id"))
    shown = chunks.withColumn("n_", nth).where(F.col("n_") <= CHUNKS)
    shown = shown.select(F.col(query).alias("q_"), F.col("doc_id").alias("d_"), F.struct("n_", "chunk_id", marked(snippet(F.col("content"), F.col("terms")), F.col("terms")).alias("chunk_text")).alias("c"))
    shown = shown.groupBy("q_", "d_").agg(F.array_sort(F.collect_list("c")).alias("c"))
    joined = scored.join(shown, scored[query].eqNullSafe(shown["q_"]) & (scored["doc_id"] == shown["d_"]), "left")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    spare = F.coalesce(filled("summary"), filled("title"), filled("file_name"))
    fallback = F.when(spare.isNotNull(), F.array(F.struct(F.col("doc_id").cast("string").alias("chunk_id"), marked(snippet(spare, F.col("terms")), F.col("terms")).alias("chunk_text"))))
    own = F.transform("c", lambda x: F.struct(x["chunk_id"].cast("string").alias("chunk_id"), x["chunk_text"].alias("chunk_text")))
    none = F.array().cast("array<struct<chunk_id:string,chunk_text:string>>")
    named = F.coalesce(filled("owner"), F.col("file_name")).alias("organization")
    results = joined.select(query, F.lit(1).alias("kind_"), F.col("rank").cast("long").alias("order_"), "doc_id", "file_name", named, "title", "score", F.coalesce(own, fallback, none).alias("chunks"))
    files = top.where("file_name <> ''").select(F.col(query).alias("q_"), F.col("file_name").alias("f_")).distinct()
    extra = literal.join(files, literal[query].eqNullSafe(files["q_"]) & (literal["file_name"] == files["f_"]), "left_anti")
    extra = extra.select(query, F.lit(0).alias("kind_"), F.col("nth").cast("long").alias("order_"), "doc_id", "file_name", named, "title", F.lit(LITERAL).alias("score"), none.alias("chunks"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("kind_", "order_", "doc_id"))
    out = extra.unionByName(results).withColumn("place", place)
    return out.select(query, "place", "doc_id", "file_name", "organization", "title", "score", F.coalesce(F.get("chunks", F.lit(0))["chunk_text"], F.lit("")).alias("chunk_text"), "chunks")


def rerank_routes(queries: DataFrame, candidates: DataFrame, query: str, fast: bool = False, breaker: bool = False, admin: bool = False) -> DataFrame:
    """(query, run, most, degraded) of each query (query, text, mode, navigational, text_hits, flatness, rerank_top_k, return_top_k).

    Candidates are reranked unless the question names what it looks for; then only where scores don't decide: weak text
    scores, a frequent short word, flat scores, or, on fast machines, notices in semantic mode.  Never for keyword searches and
    behind an open circuit breaker.  ``candidates`` has (query, es, doc_type, text); those without text can't be reranked.
    """
    held = candidates.groupBy(query).agg(F.count(F.lit(1)).alias("n_"), F.max(F.coalesce("es", F.lit(0.0))).alias("best_"), F.count(F.when(F.coalesce("text", F.lit("")) != "", 1)).alias("texts_"), F.max(F.coalesce(F.col("doc_type").isin(*NOTICES), F.lit(False))).alias("notices_"))
    q = queries.join(held.withColumnRenamed(query, "q_"), queries[query] == F.col("q_"), "left")
    any_ = F.coalesce("n_", F.lit(0)) > 0
    nav = F.coalesce("navigational", F.lit(False))
    frequent = nav & (F.length(F.trim("text")) <= SHORT) & (F.col("text_hits") > FREQUENT)
    forced = (nav & any_ & ((F.coalesce("best_", F.lit(0.0)) < WEAK) | F.coalesce(frequent, F.lit(False)) | F.coalesce(F.col("flatness") < FLAT, F.lit(False)))) | ((F.col("mode") == "semantic") & F.lit(fast) & F.coalesce("notices_", F.lit(False)))
    run = any_ & (~nav | forced) & (F.col("mode") != "keyword") & F.lit(not breaker) & (F.coalesce("texts_", F.lit(0)) > 0)
    most = F.least(F.col("rerank_top_k"), F.lit(SLOW_MOST)) if not fast and not admin else F.greatest(F.col("rerank_top_k"), F.least(F.col("return_top_k"), F.lit(MOST_SHOWN)))
    most = most if admin else F.least(most, F.lit(MOST))
    return q.select(queries[query], run.alias("run"), F.when(run, most).otherwise(0).alias("most"), (~run & F.lit(breaker)).alias("degraded"))


def collective_veto(scores: DataFrame, query: str, score: str, threshold: float, navigational: str) -> DataFrame:
    """(query, veto_ratio, any_winner, vetoed): whether all candidates of a query are answered with nothing.

    More than 70 % of five or more scores under the threshold, and none at it; never for questions that name what they look
    for.  A candidate without a score counts among the five but neither against nor for the query.
    """
    low, high = F.count_if(F.col(score) < threshold), F.max(F.coalesce(F.col(score) >= threshold, F.lit(False)))
    out = scores.groupBy(query).agg(F.count(F.lit(1)).alias("n_"), (low / F.count(F.lit(1))).alias("veto_ratio"), high.alias("any_winner"), F.max(F.coalesce(navigational, F.lit(False))).alias("nav_"))
    return out.withColumn("vetoed", (F.col("veto_ratio") > VETO_SHARE) & (F.col("n_") >= VETO_LEAST) & ~F.col("any_winner") & ~F.col("nav_")).drop("n_", "nav_")


def core_tokens(question: Column) -> Column:
    """The question's words of two or more characters that say something."""
    words = F.split(F.regexp_replace(F.coalesce(question, F.lit("")), r"[，。！？、；：,.!?;:\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*GENERIC))


def sufficient(question: Column, hits: Column, structure: Column, entities: Column, score: Column, covered: Column) -> Column:
    """Whether one document's evidence is enough: by hits, structure and entities for questions that ask for a list, else by score and coverage."""
    lists = F.lit(False)
    for word in LISTING:
        lists = lists | F.contains(F.coalesce(question, F.lit("")), F.lit(word))
    listed = (hits >= ENOUGH_LIST[0]) & (structure >= ENOUGH_LIST[1]) & (entities >= ENOUGH_LIST[2])
    return F.coalesce(F.when(lists, listed).otherwise((score >= ENOUGH[0]) & (covered >= ENOUGH[1])), F.lit(False))


def select_for_prompt(ranked: DataFrame, query: str, least: int, fallback: int) -> DataFrame:
    """The documents of each query that go into its prompt: ``ranked`` (query, question, rank, text, sufficient) with ``place``.

    Where any document holds one of the question's core tokens, only such ones stay.  If the first of them is enough by itself,
    the first ``least`` go, else the first ``fallback``, but ``least`` at least.
    """
    topical = F.coalesce(F.exists(core_tokens(F.col("question")), lambda t: F.contains(F.col("text"), t)), F.lit(False))
    w = Window.partitionBy(query)
    kept = ranked.withColumn("t_", topical).withColumn("any_", F.max("t_").over(w)).where("t_ or not any_")
    placed = kept.withColumn("place", F.row_number().over(w.orderBy("rank"))).withColumn("enough_", F.max(F.when(F.col("place") == 1, F.col("sufficient"))).over(w))
    low = max(1, least)
    return placed.where(F.col("place") <= F.when(F.col("enough_"), low).otherwise(max(low, fallback))).drop("t_", "any_", "enough_")
