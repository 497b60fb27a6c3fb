import random
import re
from collections import Counter

from foliant.operators import mining as M
from foliant.operators import pages as G

RAW = "<!-- PAGE_START: 3 -->first page text here\n<!--PAGE_START:4-->second  page with some\nmore words\n<!-- PAGE_START: 5 -->third page " + "x" * 100


def test_pages_by_hand(spark):
    chunks = ["first page", "first page text here\n<!--PAGE_START:4-->second", "second page with some more words", "third page " + "x" * 100, "no such words anywhere in it", "", None, "third page xxx and then a different ending of the chunk", "firstpagetexthere secondpage with somemorewords"]
    want = [(3, 3), (3, 4), (4, 4), (5, 5), (0, 0), (0, 0), (0, 0), (0, 0), (3, 4)]
    assert G.page_ranges(RAW, chunks) == want
    assert G.page_ranges("no marks", ["no"]) == [(0, 0)] and G.page_ranges(None, ["a"]) == [(0, 0)] and G.page_ranges(RAW, []) == []
    long = "second  page with some\nmore words" + "y" * 60  # found by its first 30 characters, held to be as long as it says
    assert G.page_ranges(RAW, [long]) == [(4, 5)]
    df = spark.createDataFrame([(1, RAW, chunks), (2, None, ["a"]), (3, RAW, None)], "id int, raw string, chunks array<string>")
    got = {r.id: [(p["first"], p["last"]) for p in r.pages] for r in G.with_pages(df, "raw", "chunks").collect()}
    assert got == {1: want, 2: [(0, 0)], 3: []}


def test_pages_against_every_place():
    """Chunks cut from a text, as they are or with other white space, are found on the pages that they were cut from."""
    rng = random.Random(2)
    for _ in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        raw = "".join(f"<!-- PAGE_START: {p + 1} -->" + " ".join(words[p * 30 : p * 30 + 30]) + "\n" for p in range(3))
        p, a, n = rng.randrange(3), rng.randrange(20), rng.randrange(1, 10)
        cut = " ".join(words[p * 30 + a : p * 30 + a + n])
        assert G.page_ranges(raw, [cut, "\n ".join(cut.split())]) == [(p + 1, p + 1)] * 2


def brute_unit(s):
    for n in range(2, min(8, len(s) // 2) + 1) if len(s) >= 4 else ():
        k = 0
        while (k + 1) * n <= len(s) and s[k * n : k * n + n] == s[:n]:
            k += 1
        if k * n * 10 >= len(s) * 8:
            return s[:n]
    return ""


def brute_grams(s, most=8):
    grams = [s[i : i + n] for n in (4, 3, 2) for i in range(len(s) - n + 1) if len(set(s[i : i + n])) > 1]
    count, first = Counter(grams), {}
    for i, g in enumerate(grams):
        first.setdefault(g, i)
    return sorted(count, key=lambda g: (-count[g], -len(g), first[g]))[:most]


def test_units_and_grams_against_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        unit = "".join(rng.choice("天地a😀") for _ in range(rng.randrange(1, 10)))
        s = (unit * rng.randrange(1, 8))[: rng.randrange(60)] + "".join(rng.choice("天地a") for _ in range(rng.randrange(6)))
        assert M.repeated_unit(s) == brute_unit(s), s
        assert M.common_grams(s) == brute_grams(s), s
    assert M.repeated_unit("ab" * 200_000) == "ab" and M.common_grams("") == []


def test_terms(spark):
    assert M.search_terms("执法检查执法检查执法检查！") [:1] == ["执法检查"] and len(M.search_terms("执法检查执法检查执法检查")) == 8
    assert M.search_terms("hello, World 7 hello") == ["hello", "World", "7"] and M.search_terms(None) == M.search_terms("  ") == []
    df = spark.createDataFrame([(1, "abcabcabc"), (2, None), (3, "12")], "id int, t string")
    got = {r.id: r.x for r in df.select("id", M.mined_terms("t", "a-z").alias("x")).collect()}
    s = re.sub("[^a-z]", "", "abcabcabc")
    assert got == {1: list(dict.fromkeys(["abc", *brute_grams(s)]))[:8], 2: [], 3: ["12"]}
