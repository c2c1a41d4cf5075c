"""Words where none are marked: runs of characters split by the most probable path over a word graph.

A run is a maximal stretch of some characters (``HAN`` by default; any script by its pattern). A dictionary is a table (word, n); a
user's table comes on top of it, its counts in place of others for the same words. A word costs ``floor(1000 * ln(total / n))``, a character that is
no word ``floor(1000 * ln(total)) + 1000``, so every run can be split; costs are whole numbers, and of two cheapest ways the one whose last words
are longer is taken, so results are the same everywhere.

Only distinct runs are split: their substrings meet the dictionary in one join, whatever its size, and the path through a run's words is
found in time linear in the run. Dictionaries can be learned: n-grams that occur often, hold together (they are more frequent than any two
parts of them would be by chance) and stand between many different neighbours are words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAN = r"\p{IsHan}+"
OTHER = r"[\p{L}\p{N}_&&[^\p{IsHan}]]+"


def run_counts(docs: DataFrame, of: str = HAN, text: str = "text") -> DataFrame:
    """(run, n): the runs of the lower-cased texts and how often each occurs."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(of), 0)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _told(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 20_000)):
        yield _told(some, names, kinds)


def _neighbours(longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (run, n): each substring of a run, what stands before and behind it, and n."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start in range(len(run)):
                    for end in range(start + 1, min(start + longest, len(run)) + 1):
                        yield run[start:end], run[start - 1 : start] if start else "", run[end : end + 1], n

    return _in_batches(rows(), ["word", "left", "right", "n"], [pa.string(), pa.string(), pa.string(), pa.int64()])


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, run, longest): (key, start, size, word) of all substrings."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, run, longest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for start in range(len(run)):
                    for size in range(1, min(longest, len(run) - start) + 1):
                        yield key, start, size, run[start : start + size]

    return _in_batches(rows(), ["key", "start", "size", "word"], [pa.string(), pa.int32(), pa.int32(), pa.string()])


def learned_words(runs: DataFrame, longest: int = 4, least: int = 5, cohesion: float = 20.0, freedom: float = 1.0) -> DataFrame:
    """(word, n) of two to ``longest`` characters, from runs (run, n): at least ``least`` times, at least ``cohesion`` times as often as any two parts of
    it would meet by chance, and with neighbours of at least ``freedom`` nats on either side (a run's end is a neighbour of its own)."""
    grams = runs.where(F.length("run") > 0).select("run", "n").mapInArrow(partial(_neighbours, longest), "word string, left string, right string, n long")
    counts = grams.groupBy("word").agg(F.sum("n").alias("n"))
    total = F.broadcast(counts.where(F.length("word") == 1).agg(F.sum("n").alias("total")))  # one row
    often = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cut = often.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cut = cut.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.lit(longest)).alias("b"))
    parts = cut.join(counts.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(total)
    held = parts.groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("cohesion")).where(F.col("cohesion") >= cohesion)
    for side in ("left", "right"):
        beside = grams.join(held.select("word", F.col("n").alias("all")), "word").groupBy("word", "all", side).agg((F.sum("n") / F.first("all")).alias("p"))
        free = beside.groupBy("word").agg(F.sum(-F.col("p") * F.log("p")).alias("nats")).where(F.col("nats") >= freedom)
        held = held.join(free.select("word"), "word", "left_semi")
    return held.select("word", "n")


def costs(dictionary: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """(word, cost, unknown) of tables (word, n): unknown is the cost of a character that is no word."""
    rows = dictionary.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    if user is not None:
        own = user.groupBy(F.lower("word").alias("word")).agg(F.max("n").alias("n"))
        rows = rows.join(own.select("word"), "word", "left_anti").unionByName(own)
    rows = rows.where((F.col("n") > 0) & (F.length("word") > 0))
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))  # one row
    return rows.crossJoin(total).select("word", F.floor(1000 * F.log(F.col("total") / F.col("n"))).alias("cost"), (F.floor(1000 * F.log(F.col("total").cast("double"))) + 1000).alias("unknown"))


def cheapest(run: str, words: list[tuple[int, int, int]], unknown: int) -> list[str]:
    """The pieces of a run; words are (start, size, cost)."""
    ending: dict[int, list[tuple[int, int]]] = {}
    for start, size, cost in words:
        ending.setdefault(start + size, []).append((size, cost))
    best, back = [0], [0]
    for end in range(1, len(run) + 1):
        # a single character that is a word has its own cost
        ways = ending.get(end, [])
        if not any(size == 1 for size, _ in ways):
            ways = [*ways, (1, unknown)]
        cost, size = min(((best[end - s] + c, -s) for s, c in ways))
        best.append(cost)
        back.append(-size)
    out, end = [], len(run)
    while end:
        out.append(run[end - back[end] : end])
        end -= back[end]
    return out[::-1]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, words, unknown = (batch.column(i).to_pylist() for i in range(3))
        pieces = [cheapest(run, [(w["start"], w["size"], w["cost"]) for w in ws], u) for run, ws, u in zip(runs, words, unknown)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.string()))], names=["run", "pieces"])


def split_runs(runs: DataFrame, priced: DataFrame) -> DataFrame:
    """(run, pieces) of distinct runs (run), by a priced dictionary (``costs``). Rows of substrings carry short runs, and of long ones a digest."""
    told = F.broadcast(priced.agg(F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest"), F.coalesce(F.max("unknown"), F.lit(1000)).alias("unknown")))  # one row
    key = F.when(F.length("run") <= 40, F.col("run")).otherwise(F.concat(F.sha2("run", 256), F.lit("#")))
    whole = runs.select("run").where(F.length("run") > 0).distinct().crossJoin(told).select(key.alias("key"), "run", "longest", "unknown")
    placed = whole.select("key", "run", "longest").mapInArrow(_substrings, "key string, start int, size int, word string")
    met = placed.join(priced.select("word", "cost"), "word").groupBy("key").agg(F.collect_list(F.struct("start", "size", "cost")).alias("words"))
    grouped = whole.join(met, "key", "left").select("run", F.coalesce("words", F.array().cast("array<struct<start:int,size:int,cost:bigint>>")).alias("words"), "unknown")
    return grouped.mapInArrow(_split, "run string, pieces array<string>")


def with_tokens(docs: DataFrame, priced: DataFrame, of: str = HAN, other: str = OTHER, key: str = "doc_id", text: str = "text", stopwords: list[str] = ()) -> DataFrame:
    """docs with their ``tokens``, in order: runs split, other words (``other``) as they are, lower-case, without stopwords. Keys are distinct."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(f"(?:{of})|(?:{other})"), 0)).alias("at", "run"))
    split = split_runs(found.where(F.col("run").rlike(f"^(?:{of})$")).select("run"), priced)
    pieces = found.join(split, "run", "left").select(key, F.struct("at", F.coalesce("pieces", F.array("run")).alias("pieces")).alias("x"))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["pieces"]))
    kept = F.filter(tokens, lambda t: ~t.isin(list(stopwords))) if stopwords else tokens
    lists = pieces.groupBy(key).agg(kept.alias("tokens"))
    return docs.join(lists, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
