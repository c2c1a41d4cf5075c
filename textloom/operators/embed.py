"""Text vectors without a model: TF-IDF over the most frequent terms, reduced by a randomised truncated SVD.

The rows of the TF-IDF matrix stay where the documents are, as lists of (term, value). The decomposition works on the terms' side, whose size is
``features``, a parameter: a random block of directions is multiplied by the matrix's own product (rows times the block, and back) a few
times, one pass over the documents each, in which tasks add up their rows' shares and only sums of features x block numbers meet; after each pass the
block is made orthonormal. The block's small matrix then gives singular values and directions, and documents are projected on them.

Null, empty and wordless texts have the zero vector. The sign of a direction is such that its largest component is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, COMPONENTS, EXTRA, PASSES = 768, 64, 16, 4


@dataclass
class Reduction:
    terms: list[str]
    idf: np.ndarray
    values: np.ndarray  # singular values, largest first
    directions: np.ndarray  # features x components


def frequent_terms(docs: DataFrame, tokens: Column, features: int = FEATURES, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The most frequent terms (ties by term), sorted, and their smoothed inverse document frequencies."""
    n = docs.count()
    counted = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    all_ = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    top = all_.join(counted, "term").orderBy(F.desc("cf"), "term").limit(features).orderBy("term").collect()  # ``features`` rows
    return [r.term for r in top], np.array([np.log((1 + n) / (1 + r.df)) + 1 for r in top])


def sparse_rows(docs: DataFrame, tokens: Column, terms: list[str], idf: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, at, value): each document's terms among ``terms`` by number and their TF-IDF values, of length 1 together."""
    sent = docs.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, idf))  # ``features`` terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight = sent.value
        for batch in batches:
            places, values = [], []
            for words in batch.column(1).to_pylist():
                at, tf = np.unique([number[w] for w in words or () if w in number], return_counts=True)
                v = tf * weight[at.astype(int)]
                places.append(at.astype(np.int32))
                values.append(v / np.linalg.norm(v) if len(v) else v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=[key, "at", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens.alias("tokens")).mapInArrow(run, f"{key} {kind}, at array<int>, value array<double>")


def _dense(batch: pa.RecordBatch, features: int) -> Iterator[np.ndarray]:
    """The rows of a batch (.., at, value), some hundred at a time, as a matrix."""
    at, value = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for s in range(0, batch.num_rows, 256):
        some, of = at.slice(s, 256), value.slice(s, 256)
        m = np.zeros((len(some), features))
        rows = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
        m[rows, some.flatten().to_numpy()] = of.flatten().to_numpy()
        yield m


def _squared(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' share of the matrix's own product with a block: a row a term."""
    w = block.value
    total = np.zeros_like(w)
    for batch in batches:
        for m in _dense(batch, len(w)):
            total += m.T @ (m @ w)
    some = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["term", "share"])


def _times(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    sent = rows.sparkSession.sparkContext.broadcast(w)
    shares = rows.select("at", "value").mapInArrow(partial(_squared, sent), "term int, share array<double>")
    summed = shares.groupBy("term").agg(F.array(*[F.sum(F.col("share")[i]) for i in range(w.shape[1])]).alias("share"))
    out = np.zeros_like(w)
    for r in summed.collect():  # ``features`` rows
        out[r.term] = r.share
    return out


def fitted(docs: DataFrame, tokens: Column, components: int = COMPONENTS, features: int = FEATURES, key: str = "doc_id", passes: int = PASSES, seed: int = 5) -> Reduction:
    terms, idf = frequent_terms(docs, tokens, features, key)
    k = min(components, len(terms))
    if not k:
        return Reduction(terms, idf, np.zeros(0), np.zeros((0, 0)))
    rows = sparse_rows(docs, tokens, terms, idf, key)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), min(len(terms), k + EXTRA))))[0]
    for _ in range(passes):
        w = np.linalg.qr(_times(rows, w))[0]
    small = w.T @ _times(rows, w)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    directions = w @ vector[:, order]
    sign = np.sign(directions[np.abs(directions).argmax(0), np.arange(k)])
    return Reduction(terms, idf, np.sqrt(np.maximum(value[order], 0)), directions * np.where(sign == 0, 1, sign))


def embedded(docs: DataFrame, tokens: Column, reduction: Reduction, key: str = "doc_id") -> DataFrame:
    """(key, embedding): documents along the directions, of length 1 where they have any of the terms."""
    rows = sparse_rows(docs, tokens, reduction.terms, reduction.idf, key)
    sent = docs.sparkSession.sparkContext.broadcast(reduction.directions)  # features x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            parts = [m @ w for m in _dense(batch, len(w))]
            v = np.vstack(parts) if parts else np.zeros((0, w.shape[1]))
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(size > 0, v / np.maximum(size, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=[key, "embedding"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, embedding array<double>")
