"""Substring search through an index of three-character grams.

Every place of a lower-cased text begins a gram: the character and the two behind it, or ends of text where there are none. A gram is one long
(three times 21 bits), so grams that begin with the same characters are a range. Tasks collect a batch's documents by gram, and those
lists, sorted by gram, are the index: no row a place, and a search reads the row groups of its own grams.

* A needle of three characters or more is met by its rarest grams, as many as ``PICKED``: documents that hold them all are candidates. A shorter one
  is met by the range of grams that begin with it.
* Candidates are compared with the needle as text, so results are those of reading every text. For the same reason documents that
  changed or went need no removal: what changed is added again, and candidates that no longer hold the needle, or are gone, drop out.
* Many needles (``held``) take the same steps as joins: each needle's rarest grams by one count of the grams asked for, their lists, and a count of
  meetings for each needle and document.

Null texts and null keys hold nothing; the empty needle is in every text that isn't null. Lower-casing is Spark's for texts and needles alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.search import top

PICKED = 4
BITS, END = 21, (1 << 21) - 1
#: Characters of a batch whose grams are collected at once.
CHARACTERS = 1 << 22


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The grams that begin at each place of a text, with its ends."""
    c = np.append(codes(text), [END, END])
    return (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]


def asked(needle: str) -> np.ndarray:
    """The distinct grams that any text with the needle has: of a needle of three characters or more."""
    return np.unique(grams(needle)[: len(needle) - 2])


def beginning(needle: str) -> tuple[int, int]:
    """The range of grams that begin with a needle of one or two characters."""
    low = high = 0
    for i in range(3):
        c = ord(needle[i]) if i < len(needle) else None
        low, high = low << BITS | (c or 0), high << BITS | (END if c is None else c)
    return low, high


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, lower-cased text): for each gram the keys of the documents with it."""
    held: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    size = 0

    def told() -> pa.RecordBatch:
        gram, key = np.concatenate(held), np.concatenate(keys)
        order = np.lexsort((key, gram))
        gram, key = gram[order], key[order]
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(gram)).astype(np.int32)), pa.array(key))
        return pa.RecordBatch.from_arrays([pa.array(gram[start]), pa.array(np.diff(np.append(start, len(gram)))), lists], names=["gram", "n", "keys"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.unique(grams(text))
            held.append(found)
            keys.append(np.full(len(found), key, np.int64))
            size += len(text)
            if size > CHARACTERS:
                yield told()
                held, keys, size = [], [], 0
    if held:
        yield told()


def _needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, lower-cased needle) of three characters or more: (id, gram)."""
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), [asked(x) for x in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in found], np.int64)
        at = np.repeat(np.arange(len(ids)), size)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["id", "gram"])


class GramIndex:
    """Lists of documents by gram, in a folder; ``add`` appends, and searches verify against the documents given to them."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.folder, self.key, self.text = spark, folder.rstrip("/"), key, text
        self._lists: DataFrame | None = None

    def add(self, docs: DataFrame) -> GramIndex:
        rows = docs.where(F.col(self.key).isNotNull() & F.col(self.text).isNotNull()).select(F.col(self.key).cast("long"), F.lower(self.text))
        lists = rows.mapInArrow(_collected, "gram long, n long, keys array<long>")
        lists.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(self.folder)
        self._lists = self.spark.read.parquet(self.folder)
        return self

    @property
    def lists(self) -> DataFrame:
        if self._lists is None:
            self._lists = self.spark.read.parquet(self.folder)
        return self._lists

    def rarest(self, needle: str) -> list[int] | None:
        """The needle's grams to look for; None where one of them is in no document."""
        wanted = asked(needle).tolist()
        known = self.lists.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()  # a row a gram of the needle
        return [r.gram for r in known[:PICKED]] if len(known) == len(wanted) else None

    def candidates(self, needle: str) -> DataFrame:
        """(key) of the documents that may hold the needle, which is lower-case and not empty."""
        if len(needle) < 3:
            low, high = beginning(needle)
            return self.lists.where(F.col("gram").between(low, high)).select(F.explode("keys").alias(self.key)).distinct()
        picked = self.rarest(needle)
        if picked is None:
            return self.lists.where("false").select(F.explode("keys").alias(self.key))
        rows = self.lists.where(F.col("gram").isin(picked)).select("gram", F.explode("keys").alias(self.key)).distinct()
        return rows.groupBy(self.key).count().where(F.col("count") == len(picked)).select(self.key)

    def search(self, needle: str, docs: DataFrame, any_case: bool = True) -> DataFrame:
        """The rows of docs whose text holds the needle."""
        text = F.lower(self.text) if any_case else F.col(self.text)
        low = self._lowered(needle)
        holds = text.contains(F.lower(F.lit(needle)) if any_case else F.lit(needle))
        rows = docs if not low else docs.join(self.candidates(low), self.key, "left_semi")
        return rows.where(holds)

    def _lowered(self, needle: str) -> str:
        """Spark's lower case of a needle."""
        return self.spark.range(1).select(F.lower(F.lit(needle)).alias("x")).first().x

    def held(self, needles: DataFrame, docs: DataFrame, id: str = "item_id", any_case: bool = False) -> DataFrame:
        """(id, key): which documents hold which needles (id, text); needles of one or two characters take their range of grams, as a join by range
        over as many rows as there are such needles; empty ones are in every text."""
        asked_for = needles.where("text is not null").select(F.col(id).alias("id"), F.col("text").alias("needle"), F.lower("text").alias("low")).distinct()
        kind = asked_for.schema["id"].dataType.simpleString()
        wanted = asked_for.where(F.length("low") >= 3).select("id", "low").mapInArrow(_needles, f"id {kind}, gram long")
        known = self.lists.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
        by_rarity = Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "gram")
        picked = wanted.join(known, "gram", "left").withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= PICKED)
        sizes = picked.groupBy("id").agg(F.count("*").alias("size"))
        met = picked.select("id", "gram").join(self.lists.select("gram", "keys"), "gram").select("id", "gram", F.explode("keys").alias(self.key)).distinct()
        pairs = met.groupBy("id", self.key).count().join(sizes, "id").where(F.col("count") == F.col("size")).select("id", self.key)
        short = asked_for.where(F.length("low").between(1, 2)).select("id", "low").collect()  # ids of needles of one or two characters
        for i in range(0, len(short), 64):
            some = [(r.id, *beginning(r.low)) for r in short[i : i + 64]]
            table = F.broadcast(self.spark.createDataFrame(some, f"id {kind}, first long, last long"))  # 64 rows
            ranges = self.lists.join(table, F.col("gram").between(F.col("first"), F.col("last"))).select("id", F.explode("keys").alias(self.key))
            pairs = pairs.unionByName(ranges.distinct())
        texts = docs.where(F.col(self.text).isNotNull()).select(F.col(self.key), F.col(self.text).alias("__text"))
        found = pairs.join(asked_for, "id").join(texts, self.key).where(_holds(any_case)).select("id", self.key)
        empty = asked_for.where("needle = ''").select("id")
        if not empty.isEmpty():
            found = found.unionByName(texts.select(self.key).crossJoin(F.broadcast(empty.distinct())).select("id", self.key))  # one row an id of an empty needle
        return found.withColumnRenamed("id", id).distinct()


def _holds(any_case: bool) -> Column:
    return F.lower("__text").contains(F.col("low")) if any_case else F.col("__text").contains(F.col("needle"))


def keyword_search(index: GramIndex, docs: DataFrame, words: list[str], k: int, name: str = "source", kind: str = "lang") -> DataFrame:
    """``search.keyword_search`` through the index: for each word 1 if the text holds it, 0.5 the name, 0.3 the kind. Texts are read for candidates
    only, names and kinds without the texts."""
    key = index.key
    hit = lambda c, w, p: F.when(F.lower(F.col(c)).contains(w.lower()), F.lit(p)).otherwise(F.lit(0.0))
    total = lambda cs: sum(cs[1:], cs[0])
    parts = [docs.select(key, total([hit(name, w, 0.5) + hit(kind, w, 0.3) for w in words]).alias("raw")).where("raw > 0")]
    parts += [index.search(w, docs.select(key, index.text)).select(key, F.lit(1.0).alias("raw")) for w in words]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    scored = rows.groupBy(key).agg(F.round(F.sum("raw"), 6).alias("raw"))
    return top(scored.withColumn("similarity", F.round(F.least(F.col("raw") / len(words), F.lit(1.0)), 6)), "raw", key, k)
