"""Text expressions: normalising, hashing, tokens, snippets.  All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿㐀-䶿]"
BLANKS = r"[\s　]+"


def strip(c: Column) -> Column:
    """Trim every Unicode blank, tabs and ideographic spaces included."""
    return F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")


def collapse_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(c, BLANKS, " "))


def half_width(c: Column) -> Column:
    """Full-width forms U+FF01-U+FF5E and the ideographic space to their ASCII forms."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)) + " "
    return F.translate(c, wide, narrow)


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def has_encoded_chinese(c: Column) -> Column:
    """Whether a text holds a percent-encoded UTF-8 ideograph."""
    return c.rlike(r"(?i)%E[4-9](%[89AB][0-9A-F]){2}")


def normalize_list(c: Column, limit: int = 500) -> Column:
    """Trimmed, non-empty, distinct in order, at most ``limit``."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def content_hash(given: Column, content: Column, text: Column) -> Column:
    """The hash given, else that of the first 8 KB of the file, else that of the first 2000 characters of text."""
    given = F.when(strip(given) != "", given)
    return F.coalesce(given, F.sha2(F.substring(content, 1, 8192), 256), F.sha2(F.substring(text, 1, 2000), 256))


def chunk_id(source: Column, version: Column, index: Column, fine: bool = False) -> Column:
    return F.concat(F.md5(source), F.lit("_v"), version.cast("string"), F.lit("_fine_" if fine else "_chunk_"), index.cast("string"))


def document_of(chunk: Column) -> Column:
    """The document hash in front of a chunk id."""
    return F.nullif(F.regexp_extract(chunk, r"^([0-9a-f]{32})_v\d+_(?:chunk|fine|qa)_", 1), F.lit(""))


def logical_index(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"_write$", ""), r"_v\d+$", "")


def index_code(c: Column) -> Column:
    return F.regexp_replace(logical_index(c), r"^kb_document_", "")


def department_code(c: Column) -> Column:
    """Region code without trailing pairs of zeros, as long as more than two characters remain."""
    return F.regexp_replace(c, r"^(.+?)(00)+$", "$1")


def department_levels(c: Column) -> Column:
    """Prefixes of 2, 4, 6 and 9 characters and the full code; short codes stand in for longer ones."""
    return F.struct(*[F.left(c, F.lit(n)).alias(f"dept_l{n}") for n in (2, 4, 6, 9)], c.alias("dept_full"))


def department_values(c: Column) -> Column:
    """``a-b-c`` -> [a, a-b, a-b-c]."""
    parts = F.split(c, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def _grams(t: Column, n: int) -> Column:
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.filter(at, lambda g: F.length(g) == n)


def ngrams(c: Column, low: int = 2, high: int = 8) -> Column:
    """Distinct character n-grams of the lower-cased text."""
    return F.array_distinct(F.flatten(F.array(*[_grams(F.lower(c), n) for n in range(low, high + 1)])))


def ngram_overlap(a: Column, b: Column, n: int) -> Column:
    """Share of the distinct n-grams of ``a`` that ``b`` contains."""
    g = ngrams(a, n, n)
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.filter(g, lambda x: F.contains(F.lower(b), x))) / F.size(g))


def keywords(c: Column, k: int) -> Column:
    """The first k distinct words of two or more letters, or runs of two or more ideographs."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{2,}|[一-鿿]{2,}"), F.lit(0))), 1, k)


def required_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(c), BLANKS), lambda t: t != ""))


def snippet(text: Column, query: Column, before: int = 40, after: int = 60, fallback: int = 100) -> Column:
    """Text around the first hit, or the beginning."""
    at = F.call_function("locate", F.lower(query), F.lower(text))
    begin = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(query) + after, F.length(text) + 1)
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substr(text, begin, end - begin), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, fallback))


def dynamic_meta(text: Column, rules: dict[str, str], chars: int = 1500) -> Column:
    """Map of rule key -> first group of its pattern in the first characters, without empty values."""
    head = F.substring(text, 1, chars)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), strip(F.regexp_extract(head, r, 1)).alias("value")) for k, r in rules.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))


def query_intent(q: Column) -> Column:
    """LIST, PROCEDURE, CONDITION, COUNT_OR_TIME, COMPARISON or FACT from the words of a question."""
    has = lambda *w: F.lower(q).rlike("|".join(w))
    return (
        F.when(has("哪些", "有哪", "列出", "清单", "list", "which"), "LIST").when(has("如何", "怎么", "流程", "步骤", "how"), "PROCEDURE")
        .when(has("条件", "要求", "资格", "condition", "require"), "CONDITION").when(has("多少", "几", "何时", "什么时候", "时间", "when", "how many"), "COUNT_OR_TIME")
        .when(has("区别", "对比", "比较", "不同", "differ", "compare"), "COMPARISON").otherwise("FACT")
    )


def html_text(c: Column) -> Column:
    """Text of a page without a parser: script and style go, tags become line breaks, entities are decoded, blank lines go."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != ""), "\n")
