"""Retrieval evaluation: recall, chunk hits, fact checks and comparison of modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages that meet the texts together where they have no words to be found by.
BLOCK = 256


def recall(expected: Column, hits: Column) -> Column:
    """The share of expected pieces of text that any hit's file name holds; 0 where nothing is expected."""
    found = F.size(F.filter(expected, lambda e: F.exists(hits, lambda h: F.contains(h, e))))
    return F.when(F.size(expected) > 0, found / F.size(expected)).otherwise(F.lit(0.0))


def chunk_hit(expected: Column, hits: Column) -> Column:
    """Whether any hit holds the expected text, in any case."""
    return F.exists(hits, lambda h: F.contains(F.lower(h), F.lower(expected)))


def facts_passed(answer: Column, facts: Column, least: float = 0.5) -> Column:
    found = F.size(F.filter(facts, lambda f: F.contains(F.lower(answer), F.lower(f))))
    return (F.size(facts) > 0) & (found / F.greatest(F.size(facts), F.lit(1)) >= least)


def passages_found(passages: DataFrame, docs: DataFrame, gram: int = 8) -> DataFrame:
    """(item_id, n_docs): for each passage the documents that hold it whole. Candidates share ``gram`` words from inside the passage,
    as its first and last word may be parts of a document's words; only they are compared as text. Passages with fewer words
    are looked for in every text, a block of passages at a time."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    sized = passages.select("item_id", F.col("text").alias("passage"), words("text").alias("w")).where("passage is not null")
    keys = sized.where(F.size("w") >= gram + 2)
    keys = keys.select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, gram), " ")).alias("k"))
    grams = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= gram)
    at = F.sequence(F.lit(1), F.size("w") - (gram - 1))
    grams = grams.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(gram)), " "))))).alias("k"))
    candidates = grams.join(keys, "k").select("doc_id", "item_id", "passage").distinct()
    held = candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    short = sized.where(F.size("w") < gram + 2).select("item_id", "passage")
    blocks = -(-short.count() // BLOCK)
    if blocks:
        dealt = short.groupBy(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks))).agg(F.collect_list(F.struct("item_id", "passage")).alias("block"))
        in_text = F.filter("block", lambda p: F.contains("text", p["passage"]))
        found = docs.select("doc_id", "text").crossJoin(dealt.select("block")).select("doc_id", F.explode(F.transform(in_text, lambda p: p["item_id"])).alias("item_id"))
        held = held.unionByName(found)
    return passages.select("item_id").join(held.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs")), "item_id", "left").fillna(0, ["n_docs"])
