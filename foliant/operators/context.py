"""What stands around a hit: neighbours, siblings, parents, synonyms, merged candidates, evidence for a prompt, claims and their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.operators.search import B, K1, term_counts, token_count
from foliant.sources.tables import spread

#: Separators of clauses, and the mark around a highlighted term.
CLAUSE_BREAKS = "[？?,、。！？]+"
MARK = ("<em class='highlight'>", "</em>")


def neighbours(hits: DataFrame, chunks: DataFrame, doc: str, at: str, before: int, after: int) -> DataFrame:
    """Chunks from ``before`` before to ``after`` after any hit of their document, with ``source_type`` hit or neighbor.

    Every hit names the places it wants, and those meet the chunks by equality, so no range join is left.  Chunks that
    repeat a place all come; null places and documents are in no window.
    """
    wanted = hits.select(doc, at).distinct().select(doc, F.explode(F.sequence(F.col(at) - before, F.col(at) + after)).alias("_at"), F.col(at).alias("_hit"))
    wanted = wanted.where("_at >= 0").groupBy(doc, "_at").agg(F.bool_or(F.col("_at") == F.col("_hit")).alias("_is_hit")).withColumnRenamed("_at", at)
    return chunks.join(wanted, [doc, at]).withColumn("source_type", F.when(F.col("_is_hit"), "hit").otherwise("neighbor")).drop("_is_hit")


def siblings(candidates: DataFrame, chunks: DataFrame, query: str, doc: str, order: list[str], score: str = "rrf", per_doc: int = 10, most: int = 300) -> DataFrame:
    """Chunks of the candidates' documents that are no candidates yet, scored three quarters of the query's least score, .01 at least.

    A query takes ``per_doc`` for each of its documents and ``most`` in all, by document and ``order``; the first of ``order`` identifies a chunk.
    """
    least = candidates.groupBy(query).agg(F.min(score).alias("_least"), F.countDistinct(doc).alias("_docs"))
    more = chunks.join(candidates.select(query, doc).distinct(), doc).join(candidates.select(query, doc, order[0]), [query, doc, order[0]], "left_anti")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(doc, *order))
    kept = more.withColumn("_n", nth).where(F.col("_n") <= most).join(least, query).where(F.col("_n") <= F.col("_docs") * per_doc)
    return kept.withColumn(score, F.greatest(F.col("_least") * 0.75, F.lit(0.01))).drop("_n", "_least", "_docs")


def with_parents(fine: DataFrame, chunks: DataFrame, key: str = "chunk_id", parent: str = "parent_chunk_id", content: str = "content") -> DataFrame:
    """Fine chunks show the content of their parent and become coarse; those without one, and coarse chunks, show their own."""
    up = chunks.select(F.col(key).alias(parent), F.col(content).alias("_up"))
    asked = F.when(F.col("granularity") == "fine", F.col(parent))
    rows = fine.withColumn(parent, asked).join(up, parent, "left")
    shown = F.coalesce("_up", content)
    return rows.withColumns({"display_content": shown, "granularity": F.when(F.col("_up").isNotNull(), "coarse").otherwise(F.col("granularity"))}).drop("_up")


def synonym_keys(rows: DataFrame) -> DataFrame:
    """(key, terms) from (id, abbr, full_terms, kind, enabled): an abbreviation stands for itself and its full terms, and where
    the kind is EQUIV each full term does so too.  A key that is an abbreviation keeps its last row, another its first."""
    full = F.filter(F.transform(F.split(F.coalesce("full_terms", F.lit("")), ","), strip), lambda t: t != "")
    r = rows.where("enabled = 1").select("id", "abbr", "kind", F.array_distinct(F.concat(F.array("abbr"), full)).alias("terms"))
    key = r.select("id", "terms", "abbr", F.explode(F.when(F.col("kind") == "EQUIV", F.col("terms")).otherwise(F.array("abbr"))).alias("key"))
    own = F.col("key") == F.col("abbr")
    return key.groupBy("key").agg(F.max_by("terms", F.struct(own, F.when(own, F.col("id")).otherwise(-F.col("id")))).alias("terms"))


def expand_synonyms(queries: DataFrame, synonyms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, terms): the terms, sorted, of every synonym key that a question contains; questions without one are left out.

    Questions name their substrings of the lengths that keys have, and these meet the keys by equality: no nested loop.
    """
    lengths = [r[0] for r in synonyms.select(F.length("key")).where(F.length("key") > 0).distinct().orderBy(F.length("key")).collect()]  # as many as there are lengths
    if not lengths:
        return queries.select(*key, F.array().cast("array<string>").alias("terms")).where(F.lit(False))
    t = F.col(text)
    at = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))
    parts = F.array_distinct(F.flatten(F.filter(F.array(*[at(n) for n in lengths]), lambda a: a.isNotNull())))
    met = queries.select(*key, F.explode(parts).alias("key")).join(synonyms, "key")
    return met.select(*key, F.explode("terms").alias("term")).distinct().groupBy(*key).agg(F.sort_array(F.collect_set("term")).alias("terms"))


def clauses(question: Column, least: int = 6) -> Column:
    """Trimmed clauses of more than ``least`` characters."""
    trimmed = F.transform(F.split(question, CLAUSE_BREAKS), lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.filter(trimmed, lambda c: F.length(c) > least)


def highlight(text: Column, query: str, most: int | None = 1500) -> Column:
    """The first ``most`` characters (None: all) with every term of two or more characters marked in any case, long terms first."""
    out = F.substring(text, 1, most) if most else text
    for term in sorted({t for t in query.split() if len(t) > 1}, key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, f"(?i)(\\Q{term}\\E)", f"{MARK[0]}$1{MARK[1]}")
    return out


def fielded_bm25(docs: DataFrame, query: str, boosts: dict[str, float], exact: dict[str, float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of rows that hold a term of the question in any field: BM25 field by field times its boost, and a boost for fields that equal the question.

    Statistics of all fields are one row from one aggregate; a null field takes no part in its own.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    counted = spread(docs.select(id_col, *boosts, *(c for c in exact or {} if c not in boosts))).select(
        id_col, *(F.struct(token_count(F.col(f)).alias("len"), term_counts(F.col(f), terms).alias("tf")).alias(f"_{f}") for f in boosts),
        sum((F.when(F.col(f) == query, b).otherwise(0.0) for f, b in (exact or {}).items()), F.lit(0.0)).alias("_exact"),
    )
    held = lambda f: F.array(*[F.count_if(F.col(f"_{f}.tf")[i] > 0) for i in range(len(terms))])
    stats = counted.agg(*(F.struct(F.count(f"_{f}.len").alias("n"), F.avg(f"_{f}.len").alias("avg"), held(f).alias("df")).alias(f"s_{f}") for f in boosts))

    def score(f: str) -> Column:
        n, avg, size = F.col(f"s_{f}.n"), F.col(f"s_{f}.avg"), F.col(f"_{f}.len")
        part = F.zip_with(f"_{f}.tf", f"s_{f}.df", lambda tf, df: F.when(tf > 0, F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))).otherwise(0.0))
        return F.coalesce(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))

    total = sum((boost * score(f) for f, boost in boosts.items()), F.col("_exact"))
    return counted.crossJoin(F.broadcast(stats)).select(id_col, total.alias("score")).where("score > 0")  # beside one row


def merge_candidates(candidates: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """(key, recall) of candidates (doc_id, source, recall) and of rows found otherwise: those that meet a candidate by id, or by
    source where they have none, add ``tag`` to its channels; the others join the candidates under it, one a key."""
    key = F.when(F.coalesce("doc_id", F.lit("")) != "", F.concat(F.lit("id:"), "doc_id")).otherwise(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))))
    tags = F.filter(F.split(F.coalesce("recall", F.lit("")), ","), lambda t: t != "")
    rows = candidates.select(key.alias("key"), tags.alias("tags"), F.lit(True).alias("own"))
    new = found.select(key.alias("key")).distinct().withColumn("tag", F.array(F.lit(tag)))
    empty = F.array().cast("array<string>")
    return rows.join(new, "key", "full").select("key", F.array_join(F.array_union(F.coalesce("tags", empty), F.coalesce("tag", empty)), ",").alias("recall"))


def assemble_evidence(docs: DataFrame, pairs: DataFrame, query: str, max_docs: int, per_doc: int, total: int, max_chars: int) -> DataFrame:
    """(query, n, file, kind, text) in prompt order.

    ``docs`` has (query, file, doc_rank, place, text): the best ``max_docs`` documents, equal texts of a file once,
    ``per_doc`` a file.  ``pairs`` has (query, file, is_latest, place, text): the first latest, non-empty one of each file
    that no document covers.  Both end at ``total`` texts or when ``max_chars`` characters are reached.
    """
    ok = (F.coalesce("text", F.lit("")) != "") & (F.coalesce(F.col("file").cast("string"), F.lit("")) != "")
    first = F.row_number().over(Window.partitionBy(query, "file", "text").orderBy("place"))
    nth = F.row_number().over(Window.partitionBy(query, "file").orderBy("place"))
    d = docs.where(ok & (F.col("doc_rank") <= max_docs)).withColumn("_n", first).where("_n = 1").withColumn("_n", nth).where(F.col("_n") <= per_doc)
    d = d.select(query, "file", F.lit("doc_chunk").alias("kind"), F.struct(F.lit(0).alias("k"), F.col("doc_rank").cast("long").alias("r"), "place").alias("_at"), "text")
    w = Window.partitionBy(query).orderBy("_at")

    def within(rows: DataFrame) -> DataFrame:
        used = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumns({"n": F.row_number().over(w), "_used": used}).where((F.col("n") <= total) & (F.col("_used") < max_chars))

    kept = within(d)
    q = pairs.where(ok & F.coalesce(F.col("is_latest"), F.lit(True))).withColumn("_n", nth).where("_n = 1").join(kept.select(query, "file").distinct(), [query, "file"], "left_anti")
    q = q.select(query, "file", F.lit("qa_pair").alias("kind"), F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("r"), "place").alias("_at"), "text")
    return within(d.unionByName(q)).select(query, "n", "file", "kind", "text")


def claim_errors(claims: DataFrame, facts: DataFrame, plan: str) -> DataFrame:
    """(plan, claim, error, what): claims (plan, claim, facts, citations) without a fact or a citation, and those that name an unknown one.

    ``facts`` has (plan, fact, citation); only positive citations count.
    """
    out = None
    for many, one, known in (("facts", "fact", facts.select(plan, "fact")), ("citations", "citation", facts.where("citation > 0").select(plan, "citation"))):
        none = claims.where(F.coalesce(F.size(many), F.lit(0)) <= 0).select(plan, "claim", F.lit(f"claim_missing_{one}").alias("error"), F.lit(None).cast("string").alias("what"))
        named = claims.select(plan, "claim", F.explode(many).alias(one)).join(known, [plan, one], "left_anti")
        rows = none.unionByName(named.select(plan, "claim", F.lit(f"claim_unknown_{one}").alias("error"), F.col(one).cast("string").alias("what")))
        out = rows if out is None else out.unionByName(rows)
    return out


def newest_of_hash(rows: DataFrame, content_hash: str, version: str) -> DataFrame:
    """Rows at the largest version of their content hash: slim maxima are joined back, so a hot hash is combined before it moves."""
    top = rows.groupBy(content_hash).agg(F.max(version).alias("_top"))
    return rows.join(top, content_hash).where(F.col(version) == F.col("_top")).drop("_top")


def readable_indices(indices: DataFrame, rules: DataFrame, name: str, subjects: list[str], admin: bool = False, default_deny: bool = False) -> DataFrame:
    """Indices that may be read: a DENY rule for one of the subjects denies, else an ALLOW rule allows; an index with
    rules for others only is denied, one without any is readable unless ``default_deny``."""
    if admin:
        return indices
    mine = F.col("subject").isin(*subjects) if subjects else F.lit(False)
    held = rules.groupBy(name).agg(F.bool_or(mine & (F.col("effect") == "DENY")).alias("_deny"), F.bool_or(mine & (F.col("effect") == "ALLOW")).alias("_allow"))
    ok = F.when(F.col("_deny"), False).when(F.col("_allow"), True).when(F.col("_deny").isNotNull(), False).otherwise(not default_deny)
    return indices.join(held, name, "left").where(ok).drop("_deny", "_allow")
