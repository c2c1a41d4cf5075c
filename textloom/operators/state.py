"""Incremental state: what to do, what changed, what is orphaned, duplicates and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    from textloom.operators.search import best_per_key

    return best_per_key(df, key, order)


def duplicate_pairs(df: DataFrame, hash_column: str, key: str) -> DataFrame:
    """(original, duplicate) of rows with one hash: each duplicate beside the group's smallest key, so pairs grow with rows."""
    first = df.groupBy(hash_column).agg(F.min(key).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(first, hash_column).where(F.col(key) != F.col("original")).select("original", F.col(key).alias("duplicate"), hash_column)


def todo(scanned: DataFrame, state: DataFrame, key: str = "path", fingerprint: str = "fp") -> DataFrame:
    """Rows whose key and fingerprint the state doesn't have."""
    return scanned.join(state.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str = "path", fingerprint: str = "fp") -> DataFrame:
    """(key, change): added, deleted, modified or unchanged."""
    both = old.select(key, F.col(fingerprint).alias("old_fp")).join(new.select(key, F.col(fingerprint).alias("new_fp")), key, "full_outer")
    change = F.when(F.col("old_fp").isNull(), "added").when(F.col("new_fp").isNull(), "deleted").when(F.col("old_fp") != F.col("new_fp"), "modified").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def orphans(chunks: DataFrame, owners: DataFrame, id: str = "chunk_id", owner: str = "fp") -> DataFrame:
    """Chunks whose owner's fingerprint is not among owners."""
    return chunks.withColumn(owner, F.split(id, "_chunk_")[0]).join(owners.select(owner).distinct(), owner, "left_anti")


def reconcile(stored: DataFrame, state: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(key, status) of stored rows: bad_id, in_state, no_file, mismatch or reconciled."""
    joined = stored.join(state.select(key, F.lit(True).alias("known")).distinct(), key, "left").join(files.select(key, F.col("fp").alias("file_fp")), key, "left")
    status = (
        F.when(~F.col("id").rlike("^[0-9a-f]{32}$"), "bad_id")
        .when(F.col("known"), "in_state")
        .when(F.col("file_fp").isNull(), "no_file")
        .when(F.col("file_fp") != F.col("id"), "mismatch")
        .otherwise("reconciled")
    )
    return joined.select(key, status.alias("status"))


def rebuilt(old: DataFrame, *sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, status): the union of the sources against the old state: kept, added or removed."""
    new = sources[0].select(key)
    for s in sources[1:]:
        new = new.unionByName(s.select(key))
    new = new.distinct().withColumn("in_new", F.lit(True))
    both = old.select(key).distinct().withColumn("in_old", F.lit(True)).join(new, key, "full_outer")
    return both.select(key, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("kept").alias("status"))


def cached_tokens(docs: DataFrame, cache: DataFrame, key: str = "doc_id", signature: str = "sig") -> DataFrame:
    """docs with the tokens that the cache has for (key, signature); null where they must be made."""
    return docs.join(cache.select(key, signature, "tokens"), [key, signature], "left")


def by_document(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's chunks in order, and how many."""
    w = Window.partitionBy(key)
    return chunks.withColumn("total_chunks", F.count("*").over(w))
