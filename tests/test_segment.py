"""Segmentation against all ways to split short runs; dictionaries learned from texts; BM25 over Chinese."""

import itertools
import math
import random

from pyspark.sql import functions as F

from textloom.operators import index as I
from textloom.operators import segment as S

WORDS = [("数据", 50), ("数据仓库", 20), ("仓库", 30), ("库", 5), ("查询", 40), ("查", 2), ("加气站", 10), ("加气", 3), ("的", 200), ("标签", 25), ("治理", 25)]


def price(words):
    total = sum(n for _, n in words)
    return {w: math.floor(1000 * math.log(total / n)) for w, n in words}, math.floor(1000 * math.log(total)) + 1000


def all_ways(run):
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        pieces, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                pieces.append(run[start:i])
                start = i
        yield [*pieces, run[start:]]


def best_way(run, words):
    cost, unknown = price(words)
    ways = [(sum(cost.get(p, unknown) for p in way), [-len(p) for p in reversed(way)], way) for way in all_ways(run) if all(p in cost or len(p) == 1 for p in way)]
    return min(ways)[2]


def test_the_cheapest_of_all_ways(spark):
    rnd = random.Random(2)
    runs = ["".join(rnd.choice("数据仓库查询加气站的标签治理新") for _ in range(rnd.randint(1, 9))) for _ in range(60)] + ["数据仓库查询", "加气站的数据"]
    priced = S.costs(spark.createDataFrame(WORDS, "word string, n long"))
    got = {r.run: r.pieces for r in S.split_runs(spark.createDataFrame([(r,) for r in runs], "run string"), priced).collect()}
    assert got == {r: best_way(r, WORDS) for r in runs}
    assert got["数据仓库查询"] == ["数据仓库", "查询"]


def test_ties_and_a_user_s_words(spark):
    base = spark.createDataFrame([("ab", 8), ("cd", 8), ("a", 8), ("bcd", 8), ("AB", 0)], "word string, n long")
    run = spark.createDataFrame([("abcd",), ("xabx",)], "run string")
    split = lambda user: {r.run: r.pieces for r in S.split_runs(run, S.costs(base, user)).collect()}
    assert split(None) == {"abcd": ["a", "bcd"], "xabx": ["x", "ab", "x"]}  # of two cheapest ways the longer last word
    assert split(spark.createDataFrame([("Abcd", 5), ("b", 0)], "word string, n long"))["abcd"] == ["abcd"]
    none = S.costs(base.limit(0))
    assert {r.run: r.pieces for r in S.split_runs(run, none).collect()} == {"abcd": list("abcd"), "xabx": list("xabx")}
    assert S.split_runs(run.limit(0), S.costs(base)).count() == 0


def test_long_runs(spark):
    run = "数据仓库查询的" * 4000
    got = S.split_runs(spark.createDataFrame([(run,)], "run string"), S.costs(spark.createDataFrame(WORDS, "word string, n long"))).first().pieces
    assert got == ["数据仓库", "查询", "的"] * 4000


def test_words_are_learned(spark):
    rnd = random.Random(7)
    alphabet = [chr(0x4E00 + i) for i in range(300)]
    planted = ["数据仓库", "加气站", "标签"]
    texts = ["".join(rnd.choice(planted) if rnd.random() < 0.1 else rnd.choice(alphabet) for _ in range(60)) + " abc" for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.word: r.n for r in S.learned_words(S.run_counts(docs)).collect()}
    assert set(planted) <= set(found) and all(found[w] == sum(t.count(w) for t in texts) for w in planted)
    assert len(found) < 12 and "数据仓" not in found and "据仓库" not in found  # parts of words have too few neighbours


def test_bm25_over_chinese(spark):
    texts = {1: "数据仓库的查询 SQL", 2: "加气站标签治理，标签", 3: "query of the 数据", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokened = S.with_tokens(docs, S.costs(spark.createDataFrame(WORDS, "word string, n long")), stopwords=["的", "the"])
    assert {r.doc_id: r.tokens for r in tokened.collect()} == {1: ["数据仓库", "查询", "sql"], 2: ["加气站", "标签", "治理", "标签"], 3: ["query", "of", "数据"], 4: [], 5: []}
    got = I.score(I.build(tokened, F.col("tokens")), ["标签", "查询"], floor=False).orderBy(F.desc("score")).collect()
    assert [r.doc_id for r in got] == [2, 1]
