"""What follows retrieval: contexts for an answer, extracts, two-stage ranking, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import search as S


def context(hits: DataFrame, text: str = "text", rank: str = "rank", most: int = 1500) -> DataFrame:
    """One text of the hits in order, each under its number and cut; with the first three as sources. Hits are a top-k list."""
    part = F.concat(F.lit("[文档"), F.col(rank).cast("string"), F.lit("] "), F.substring(text, 1, most))
    held = hits.agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t"), F.col("doc_id").alias("d")))).alias("x"))
    return held.select(F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("context"), F.slice(F.transform("x", lambda s: s["d"]), 1, 3).alias("sources"))


def extract(text: Column | str, word: str, n: int = 3, least: int = 5) -> Column:
    """The first n lines, longer than least, that hold a word."""
    t = F.col(text) if isinstance(text, str) else text
    return F.slice(F.filter(F.split(t, "\n"), lambda line: (F.length(line) > least) & F.contains(F.lower(line), F.lit(word.lower()))), 1, n)


def two_stage(vectors: DataFrame, query: list[float], k: int, rescore: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The min(2k, 20) nearest, ranked anew by another query vector, of which the k best."""
    first = S.nearest(vectors, query, min(2 * k, 20), key=key, vector=vector).select(key)
    again = vectors.join(F.broadcast(first), key).select(key, F.round(V.cosine(vector, V.literal(rescore)), 6).alias("score"))
    return S.top(again, "score", key, k)


def weights(spec: Column | str, defaults: dict[str, float]) -> Column:
    """k=v,... over defaults; what is no number is skipped, unknown keys are kept."""
    s = F.col(spec) if isinstance(spec, str) else spec
    given = F.transform_values(F.str_to_map(s, F.lit(","), F.lit("=")), lambda k, v: v.try_cast("double"))
    given = F.map_filter(given, lambda k, v: v.isNotNull())
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)


def redacted(values: Column | str, secret: tuple[str, ...] = ("password", "token", "secret", "api_key", "authorization")) -> Column:
    """A map with the values of secret keys as ***."""
    m = F.col(values) if isinstance(values, str) else values
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(list(secret)), F.lit("***")).otherwise(v))


def allowed(values: Column | str, keys: list[str]) -> Column:
    m = F.col(values) if isinstance(values, str) else values
    return F.map_filter(m, lambda k, v: k.isin(keys))


def compared(old: Column, new: Column) -> dict[str, Column]:
    """Features added and removed between two lists."""
    return {"added": F.array_sort(F.array_except(new, old)), "removed": F.array_sort(F.array_except(old, new)), "kept": F.array_sort(F.array_intersect(old, new))}


def processing_report(df: DataFrame, group: list[str], ok: Column, seconds: Column) -> DataFrame:
    """Totals, successes, success rate and mean time."""
    return df.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.round(F.avg(seconds), 6).alias("avg_seconds"), F.bool_and(ok).alias("all_ok"))


def tf_idf(postings: DataFrame, terms: DataFrame, corpus: DataFrame, key: str = "doc_id", n: int = 5) -> DataFrame:
    """Each document's n terms of highest tf * ln((1 + N) / (1 + df)) + 1, lengths normalised."""
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = postings.join(terms.crossJoin(F.broadcast(corpus)).select("term", idf.alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = weighted.join(norms, key).select(key, "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
    return S.best_per_key(scored, key, [F.desc("weight"), F.col("term")], n)
