"""The gram index against reading every text."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import grams, search

ALPHABET = "abAB ñÉ漢🙂.\n"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 2, 3, 40, 300]))) for _ in range(150)]
    return [*made, None, "a" * 5000, "ΟΔΟΣ İstanbul", "end ab"]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("g") / "docs")
    rows = [(i, t, f"src{i % 9}", "xy"[i % 2]) for i, t in enumerate(texts)] + [(None, "abab", "src1", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return grams.GramIndex(spark, f"file://{tmp_path_factory.mktemp('gi')}/i").add(docs)


def test_grams_by_hand():
    assert [tuple(int(g) >> s & grams.END for s in (42, 21, 0)) for g in grams.grams("a🙂")] == [(97, 0x1F642, grams.END), (0x1F642, grams.END, grams.END)]
    assert len(grams.asked("abab")) == 2 and grams.beginning("a")[0] <= grams.grams("azz")[0] <= grams.beginning("a")[1]


def test_needles_of_all_lengths(docs, index, texts):
    needles = {1: "abab", 2: "ab", 3: "ñ", 4: "🙂", 5: "b.\na", 6: "aaaaaaaaaaaa", 7: "", 8: "zzz", 9: "οδος", 10: "A", 11: "x", 12: "é漢", 13: None}
    table = index.spark.createDataFrame([(i, n, "clash") for i, n in needles.items()], "item_id int, text string, low string")
    for any_case in (True, False):
        fold = F.lower if any_case else (lambda c: F.col(c) if isinstance(c, str) else c)
        wanted = {(i, r.doc_id) for i, n in needles.items() if n is not None for r in docs.where(fold("text").contains(fold(F.lit(n)))).collect() if r.doc_id is not None or n == ""}
        got = [tuple(r) for r in index.held(table, docs, any_case=any_case).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    for needle in ("abab", "É", "b", "", "none of it"):
        assert {r.doc_id for r in index.search(needle, docs).collect()} - {None} == {r.doc_id for r in docs.where(F.lower("text").contains(needle.lower())).collect()} - {None}


def test_keyword_search_is_the_same_through_the_index(docs, index):
    known = docs.where("doc_id is not null")
    for words in (["abab", "src1", "Y"], ["ñ"], ["zzz", "qqq"]):
        assert grams.keyword_search(index, known, words, 15).collect() == search.keyword_search(known, words, 15).collect()


def test_changed_documents(spark, docs, tmp_path):
    index = grams.GramIndex(spark, f"file://{tmp_path}/i").add(docs)
    changed = docs.where("doc_id between 10 and 20").withColumn("text", F.lit("quite new"))
    index.add(changed)
    now = docs.where("doc_id > 20").unionByName(changed)
    assert {r.doc_id for r in index.search("ite n", now).collect()} == set(range(10, 21))
    assert {r.doc_id for r in index.search("ab", now).collect()} == {r.doc_id for r in now.where(F.lower("text").contains("ab")).collect()}


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = grams.GramIndex(spark, f"file://{tmp_path}/i").add(none)
    assert index.search("abc", none).count() == 0 and index.search("a", none).count() == 0
    assert index.held(spark.createDataFrame([(1, "abc"), (2, "a")], "item_id int, text string"), none).count() == 0
