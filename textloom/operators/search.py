"""Ranked retrieval: nearest neighbours, keyword scores, and the ways to merge ranked lists.

Ties are broken by key everywhere, so results are the same on any number of executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as V


#: Query vectors in one broadcast matrix, and its bytes.
QUERY_BLOCK, QUERY_BYTES = 1 << 15, 64 << 20


def top(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(key)).limit(k)


def best_per_key(df: DataFrame, key: str | list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark cuts each partition down before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def ranked(df: DataFrame, by: str, key: str, k: int, name: str = "rank") -> DataFrame:
    """The top k with their places from 1. Only k rows meet in one task."""
    return top(df, by, key, k).withColumn(name, F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(key))))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", kind: str = "cosine", least: float | None = None, where: Column | None = None) -> DataFrame:
    """(key, score) of the k nearest by cosine, or by half, one (from cosine distance), l2 or l2_inverse. The query vector is a
    literal, so the plan is a narrow map and a top-k."""
    q = V.literal(query)
    if kind == "cosine":
        score = V.cosine(vector, q)
    elif kind in ("half", "one"):
        score = V.similarity(1 - V.cosine(vector, q), kind)
    elif kind == "l2":
        score = F.lit(0.0) - V.euclidean(vector, q)
    else:
        score = V.similarity(V.euclidean(vector, q) * V.euclidean(vector, q), "inverse")
    rows = vectors if where is None else vectors.where(where)
    scored = rows.where(V.is_valid(vector)).select(key, F.round(score, 6).alias("score"))
    return top(scored if least is None else scored.where(F.col("score") > least), "score", key, k)


def nearest_per_collection(vectors: DataFrame, query: list[float], weights: dict[int, float], n: int, k: int, collection: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n nearest of each collection, weighted by collection, and of all those the k best."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    rows = vectors.where(F.col(collection).isin(list(weights)))
    scored = rows.select(key, collection, F.round(V.similarity(1 - V.cosine(vector, V.literal(query)), "half"), 6).alias("similarity"))
    kept = best_per_key(scored, collection, [F.col("similarity").desc(), F.col(key)], n)
    return top(kept.withColumn("weighted", F.round(F.col("similarity") * weight[F.col(collection)], 6)), "weighted", key, k)


def nearest_of_many(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = "label", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score): for each query row its k nearest by cosine, itself left out; with ``group`` those of the same group only. Queries are taken in
    blocks of at most about ``block`` rows and QUERY_BYTES, each broadcast as one matrix; a task keeps the best of its rows for each query, and those are merged."""
    spark = vectors.sparkSession
    sides = [df.where(V.is_valid(vector)).select(F.col(key).cast("long").alias(key), (F.col(group) if group else F.lit(0)).cast("long").alias("g"), F.col(vector).cast("array<double>").alias("v")) for df in (queries, vectors)]
    sides = [df.where(F.col(key).isNotNull() & F.col("g").isNotNull()) for df in sides]
    size = sides[0].agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-size.rows // block), -(-8 * size.numbers // QUERY_BYTES))
    found = None
    for b in range(blocks):
        rows = sides[0].where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [np.array(r[2]) for r in rows]))
        best = sides[1].mapInArrow(partial(_nearest_in_task, held, k, key), f"query_id long, {key} long, score double")
        found = best if found is None else found.unionByName(best)
    return best_per_key(found.withColumn("score", F.round("score", 6)), "query_id", [F.col("score").desc(), F.col(key)], k)


def _nearest_in_task(held, k: int, key_name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of a task's rows for each query: k, and those that tie with the last of them once rounded."""
    ids, groups, raw = held.value
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    by_size = {n: np.flatnonzero([len(v) == n for v in raw]) for n in {len(v) for v in raw}}
    asked = {n: unit(np.array([raw[i] for i in at])) for n, at in by_size.items()}
    kept: dict[int, list[tuple[float, int]]] = {}
    for batch in batches:
        key, group, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        sizes = np.array([len(v) for v in rows])
        for n, at in by_size.items():
            mine = np.flatnonzero(sizes == n)
            if not len(mine):
                continue
            matrix = unit(np.array([rows[i] for i in mine]))
            for s in range(0, len(at), 256):
                some = at[s : s + 256]
                score = np.round(asked[n][s : s + 256] @ matrix.T, 6)
                score[(groups[some][:, None] != group[mine]) | (ids[some][:, None] == key[mine])] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if len(mine) > k else np.full(len(some), -np.inf)
                for i, row in enumerate(score):
                    near = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    best = kept.get(int(some[i]), []) + [(float(row[j]), int(key[mine[j]])) for j in near]
                    kept[int(some[i])] = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    out = [(int(ids[q]), key, score) for q, best in kept.items() for score, key in best]
    for s in range(0, len(out), 50_000):
        columns = list(zip(*out[s : s + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", key_name, "score"])


def ranked_per_query(hits: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(vector_hits: DataFrame, word_hits: DataFrame, key: str, n: int, k: int = 60) -> DataFrame:
    """Two ranked lists (key, rank) by the sum of 1 / (k + rank), and which of them found each hit."""
    v = vector_hits.select(key, F.col("rank").alias("vector_rank"))
    w = word_hits.select(key, F.col("rank").alias("word_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    match = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("word_rank").isNull(), "vector").otherwise("both")
    merged = v.join(w, key, "full_outer").select(key, F.round(part("vector_rank") + part("word_rank"), 6).alias("rrf_score"), match.alias("match_type"))
    return top(merged, "rrf_score", key, n)


def min_max(hits: DataFrame, by: str = "score", name: str = "normalised") -> DataFrame:
    """Scores of a list scaled to 0..1; all 1 where they are equal. The bounds are one aggregated row."""
    bounds = hits.agg(F.min(by).alias("__low"), F.max(by).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(by) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.lit(1.0))
    return hits.crossJoin(F.broadcast(bounds)).withColumn(name, scaled).drop("__low", "__high")


def linear_fusion(vector_hits: DataFrame, word_hits: DataFrame, key: str, n: int, vector_weight: float = 0.6, word_weight: float = 0.4) -> DataFrame:
    """Weighted sum of scores over the union of two lists (key, score); the weights are scaled to sum 1."""
    a, b = (min(1.0, max(0.0, w)) for w in (vector_weight, word_weight))
    a, b = (a / (a + b), b / (a + b)) if a + b else (0.5, 0.5)
    merged = vector_hits.select(key, F.col("score").alias("v")).join(word_hits.select(key, F.col("score").alias("w")), key, "full_outer")
    score = a * F.coalesce("v", F.lit(0.0)) + b * F.coalesce("w", F.lit(0.0))
    return top(merged.select(key, F.round(score, 6).alias("score")), "score", key, n)


def merge_three(first: DataFrame, second: DataFrame, third: DataFrame, key: str, n: int) -> DataFrame:
    """Three lists (key, score): where the second meets the first their mean, where the third meets either 1.1 of it."""
    a, b, c = (df.select(key, F.col("score").alias(x)) for df, x in ((first, "a"), (second, "b"), (third, "c")))
    two = a.join(b, key, "full_outer").select(key, F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b").alias("ab"), F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"))
    all3 = two.join(c, key, "full_outer")
    score = F.when(F.col("ab").isNull(), F.col("c")).when(F.col("c").isNull(), F.col("ab")).otherwise(F.col("ab") * 1.1)
    methods = F.array_join(F.array_compact(F.array(F.when(F.col("in_a"), "vector"), F.when(F.col("in_b"), "bm25"), F.when(F.col("c").isNotNull(), "third"))), "+")
    return top(all3.select(key, F.round(score, 6).alias("score"), methods.alias("methods")), "score", key, n)


def with_fallback(fused: DataFrame, vector_hits: DataFrame, word_hits: DataFrame, key: str, n: int) -> DataFrame:
    """fused, unless it has fewer than min(3, n) hits and one of the lists has more: then that list."""
    sizes = [F.broadcast(df.limit(n).agg(F.count("*").alias(x))) for df, x in ((fused, "nf"), (vector_hits, "nv"), (word_hits, "nw"))]
    counts = reduce(lambda x, y: x.crossJoin(y), sizes)
    short = F.col("nf") < min(3, n)
    choice = F.when(short & (F.col("nv") > F.col("nf")), "v").when(short & (F.col("nw") > F.col("nf")), "w").otherwise("f")
    lists = reduce(DataFrame.unionByName, [df.select(key, "score", F.lit(x).alias("__from")) for df, x in ((fused, "f"), (vector_hits, "v"), (word_hits, "w"))])
    return top(lists.crossJoin(F.broadcast(counts.select(choice.alias("__choice")))).where("__from = __choice").select(key, "score"), "score", key, n)


def keyword_scores(docs: DataFrame, words: list[str], text: str = "text", name: str = "source", kind: str = "lang") -> Column:
    """For each word 1 if the text holds it, 0.5 the name, 0.3 the kind."""
    hit = lambda c, w, p: F.when(F.lower(F.col(c)).contains(w.lower()), F.lit(p)).otherwise(F.lit(0.0))
    return reduce(lambda a, b: a + b, [hit(text, w, 1.0) + hit(name, w, 0.5) + hit(kind, w, 0.3) for w in words])


def keyword_search(docs: DataFrame, words: list[str], k: int, key: str = "doc_id") -> DataFrame:
    scored = docs.select(key, F.round(keyword_scores(docs, words), 6).alias("raw")).where("raw > 0")
    return top(scored.withColumn("similarity", F.round(F.least(F.col("raw") / len(words), F.lit(1.0)), 6)), "raw", key, k)


def keyword_vector_hybrid(docs: DataFrame, word_hits: DataFrame, vector_hits: DataFrame, words: list[str], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits of either list (key, similarity) at their higher similarity, then 0.7 of it and 0.3 of the share of words in the text's head."""
    both = word_hits.select(key, "similarity").unionByName(vector_hits.select(key, "similarity")).groupBy(key).agg(F.max("similarity").alias("similarity"))
    head = F.lower(F.substring(text, 1, 200))
    share = reduce(lambda a, b: a + b, [F.when(head.contains(w.lower()), 1.0).otherwise(0.0) for w in words]) / len(words)
    # at most as many rows as both lists have
    scored = docs.join(F.broadcast(both), key).select(key, F.round(0.3 * share + 0.7 * F.col("similarity"), 6).alias("score"))
    return top(scored, "score", key, k)


def occurrences(text: Column | str, word: str) -> Column:
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return ((F.length(t) - F.length(F.regexp_replace(t, re.escape(word.lower()), ""))) / len(word)).cast("long")


def contains_rank(docs: DataFrame, query: str, k: int, key: str = "doc_id") -> DataFrame:
    """1.0 where the text holds the whole query, 0.8 the name, 0.5 the kind; 0.3 more where the text holds any of its words; above 0.5."""
    words = [w for w in query.lower().split() if w]
    t = F.lower("text")
    base = F.when(t.contains(query.lower()), 1.0).when(F.lower("source").contains(query.lower()), 0.8).when(F.lower("lang").contains(query.lower()), 0.5).otherwise(0.0)
    more = F.when(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), 0.3).otherwise(0.0)
    return top(docs.select(key, F.round(base + more, 6).alias("score")).where("score > 0.5"), "score", key, k)


def matches(filters: dict) -> Column:
    """A predicate from a dict: list: in; dict of operators: compare; scalar: equal; all must hold."""
    compare = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
    parts = []
    for name, value in filters.items():
        if isinstance(value, (list, tuple, set)):
            parts.append(F.col(name).isin(list(value)))
        elif isinstance(value, dict):
            for op, v in value.items():
                parts.append(F.col(name).isin(v) if op == "$in" else ~F.col(name).isin(v) if op == "$nin" else getattr(F.col(name), compare[op])(v))
        else:
            parts.append(F.col(name) == value)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else F.lit(True)


def loosely_matches(filters: dict, dtypes: dict[str, str]) -> Column:
    """Equal, or for strings holding the value in any case; columns that do not exist match nothing."""
    parts = []
    for name, value in filters.items():
        if name not in dtypes:
            parts.append(F.lit(False))
        elif dtypes[name] == "string":
            parts.append(F.lower(F.col(name)).contains(str(value).lower()))
        else:
            parts.append(F.col(name) == value)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else F.lit(True)


def rerank(hits: DataFrame, query: str, k: int, key: str = "doc_id", score=None) -> DataFrame:
    """The k best by a score of (query, text cut to 512, white space collapsed): by default the share of the query's words in it."""
    from textloom.functions.text import clean, tokens

    text = F.substring(clean("text"), 1, 512)
    if score is None:
        words = F.array(*map(F.lit, sorted(set(query.lower().split()))))
        value = F.size(F.array_intersect(words, tokens(text))) / F.size(words)
    else:
        value = score(F.lit(query), text)
    return ranked(hits.withColumn("rerank_score", F.round(value, 6)), "rerank_score", key, k)
