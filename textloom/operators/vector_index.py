"""Nearest neighbours through cells: a stored index whose searches read only the files of the cells they probe.

Vectors are dealt to cells by the nearest of some centroids (by angle), found by mini-batch k-means as Spark jobs: in each round a batch of
rows, chosen by hash, is summed by centroid inside tasks, and only sums meet on the driver. Rows lie in a snapshot table clustered
by cell, so a cell's rows share files, crowded cells fill several, the log's ranges prune the others, and upserts and deletes rewrite
only the files that they touch.

A search probes the cells of the nearest centroids (``probes``, approximate) or, without a number, is exact: every cell keeps its
widest angle, no row of a cell is nearer to a query than the angle to its centroid less that, and cells are read until none that is left
could hold a better row. Scores are cosines of the vectors as given, rounded to six places, ties broken by key.

Vectors without a direction (zero), or of another length than the centroids, are kept in cell -1 and score 0 as everywhere in the engine;
null, empty and non-finite ones are kept there too and never found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.search import best_per_key, nearest
from textloom.sources.snapshot import SnapshotTable

MOST_CELLS = 4096
#: Rows of a training round, and bytes of the sample that the centroids start from and of the queries that one scan answers.
BATCH_ROWS, ROUNDS = 1 << 17, 6
SAMPLE_BYTES, QUERY_BYTES = 32 << 20, 64 << 20
NOWHERE = -1
SLACK = 2e-6  # rounding of scores, and of bounds


def units(rows: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors have a direction (and, if given, the length ``dim``), and those as rows of length 1."""
    ok = np.array([bool(v) and (dim is None or len(v) == dim) and None not in v and np.isfinite(v).all() and any(v) for v in rows], bool)
    some = [v for v, o in zip(rows, ok) if o]
    if not some:
        return ok, np.zeros((0, max(0, dim or 0)))
    m = np.array(some, np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return ok, m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _summed(centroids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = centroids.value
    total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
    for batch in batches:
        _, u = units(batch.column(0).to_pylist(), c.shape[1])
        if len(u):
            cell = (u @ c.T).argmax(1)
            np.add.at(total, cell, u)
            n += np.bincount(cell, minlength=len(c))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cell", "n", "total"])


def trained(vectors: DataFrame, key: str, vector: str, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centroids, at most ``cells`` (the root of the number of rows, up to MOST_CELLS)."""
    spark = vectors.sparkSession
    rows = vectors.where(F.size(vector) > 0).select(key, F.col(vector).cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return np.zeros((0, 0))
    dim, count = lengths["dim"], lengths["count"]
    cells = max(1, min(MOST_CELLS, cells or round(math.sqrt(count))))
    bound = max(1, min(16 * cells, SAMPLE_BYTES // (8 * dim)))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    first = rows.where(F.size("v") == dim).where(place < int(min(1.0, 1.5 * bound / count) * (1 << 30)) + 1).orderBy(place, key).limit(bound).collect()
    _, sample = units([r.v for r in first], dim)
    if not len(sample):
        return np.zeros((0, dim))
    c = np.unique(sample, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:cells]]
    weight = np.ones(len(c))
    parts = max(1, -(-count // BATCH_ROWS))
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(c)
        batch = rows.where(F.pmod(F.xxhash64(key, F.lit(seed + 1 + r)), F.lit(parts)) == 0).select("v")
        sums = batch.mapInArrow(partial(_summed, sent), "cell int, n long, total array<double>")
        merged = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
        for x in merged.collect():  # a row a centroid
            c[x.cell] = c[x.cell] * (weight[x.cell] if parts > 1 else 0) + np.array(x.total)
            weight[x.cell] += x.n
        size = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(size > 0, c / np.maximum(size, 1e-300), np.eye(1, dim))
    return c


def _assigned(centroids, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = centroids.value
    for batch in batches:
        ok, u = units(batch.column(at).to_pylist(), c.shape[1] if len(c) else -1)
        cell, angle = np.full(batch.num_rows, NOWHERE, np.int32), np.zeros(batch.num_rows)
        if len(u):
            cosines = u @ c.T
            cell[ok] = cosines.argmax(1)
            angle[ok] = _angles(cosines.max(1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *batch.columns], names=["cell", "angle", *batch.schema.names])


def _probed(held, key_name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, key, vector) against the queries that probe their cell: the k best of a task's rows for each query."""
    ids, q, by_cell, k = held.value
    best_score, best_key = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for batch in batches:
        cell, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((key, cell))
        edges = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1])).tolist() + [len(order)]
        for s, e in zip(edges, edges[1:]):
            asked = by_cell.get(int(cell[order[s]]))
            if asked is None:
                continue
            mine = order[s:e]
            rows = batch.column(2).take(pa.array(mine)).to_pylist()
            ok, u = units(rows, q.shape[1])
            valid = np.array([bool(v) and None not in v and np.isfinite(v).all() for v in rows], bool)
            whole = np.zeros((len(rows), q.shape[1]))
            whole[ok] = u
            for i in range(0, len(asked), 512):
                some = asked[i : i + 512]
                score = np.round(q[some] @ whole.T, 6) + 0.0
                score[:, ~valid] = -np.inf
                score[ids[some][:, None] == key[mine]] = -np.inf
                take = np.argsort(-score, axis=1, kind="stable")[:, :k]
                both = np.hstack([best_score[some], np.take_along_axis(score, take, 1)])
                keys = np.hstack([best_key[some], key[mine][take]])
                keep = np.lexsort((keys, -both), axis=1)[:, :k]
                best_score[some], best_key[some] = np.take_along_axis(both, keep, 1), np.take_along_axis(keys, keep, 1)
    i, j = np.nonzero(best_score > -np.inf)
    for s in range(0, len(i), 50_000):
        a, b = i[s : s + 50_000], j[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best_key[a, b]), pa.array(best_score[a, b])], names=["query_id", key_name, "score"])


class VectorIndex:
    """Centroids and a snapshot table of rows: cell, angle (to the cell's centroid), and the columns given."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", vector: str = "embedding", file_rows: int = 1_000_000):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector
        self.rows = SnapshotTable(spark, f"{self.folder}/rows", [key], cluster=["cell"], file_rows=file_rows)
        self._cells: tuple[int, dict] | None = None

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        c = trained(vectors, self.key, self.vector, cells)
        schema = "cell int, centroid array<double>"
        self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], schema).coalesce(1).write.parquet(f"{self.folder}/centroids")
        self.rows.append(self.assigned(vectors))
        return self

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))

    def assigned(self, vectors: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(self.centroids())
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), *vectors.schema.fields])
        return vectors.mapInArrow(partial(_assigned, sent, vectors.columns.index(self.vector)), schema)

    def upsert(self, vectors: DataFrame) -> int:
        return self.rows.upsert(self.assigned(vectors))

    def delete(self, ids: DataFrame) -> int:
        return self.rows.delete(ids)

    def directory(self) -> dict[int, tuple[int, float]]:
        """Of each cell its rows and its widest angle, as of the last version."""
        version = self.rows.snapshot().version
        if self._cells is None or self._cells[0] != version:
            told = self.rows.read(version).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()  # a row a cell
            self._cells = (version, {r.cell: (r.n, r.angle) for r in told})
        return self._cells[1]

    def read(self, cells: list[int], where: Column | None = None) -> DataFrame:
        """Rows of some cells, from the files that may hold them."""
        rows = self.rows.read(values={"cell": cells}).where(F.col("cell").isin(cells))
        return rows if where is None else rows.where(where)

    def files(self, cells: list[int]) -> int:
        return len(self.rows.pruned(self.rows.snapshot(), None, {"cell": cells}))

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells that hold rows, their centroids' cosines with unit queries, and the highest cosine that a row of each can have."""
        told = self.directory()
        cells = np.array(sorted(told), np.int64)
        angle = np.array([told[c][1] for c in cells.tolist()])
        c = self.centroids()
        middle = np.zeros((len(q), len(cells)))
        real = np.flatnonzero(cells >= 0)
        if len(real):
            middle[:, real] = q @ c[cells[real]].T
        bound = np.cos(np.maximum(0, _angles(middle) - angle))
        bound[:, cells < 0] = 0.0  # no direction: score 0
        return cells, middle, bound + SLACK

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """(key, score) of the k nearest rows; exact without ``probes``."""
        _, q = units([query])
        cells, middle, bound = self._bounds(q) if len(q) else (np.array(sorted(self.directory())), np.zeros((1, len(self.directory()))), np.ones((1, len(self.directory()))))
        order = np.argsort(-middle[0], kind="stable")
        found = lambda some: nearest(self.read([int(x) for x in cells[some]], where), query, k, self.key, self.vector)
        if probes is not None:
            return found(order[:probes])
        first = order[: max(1, min(len(order), round(math.sqrt(len(order)))))]
        seen = found(first).collect()  # k rows
        least = seen[-1].score if len(seen) == k else -np.inf
        needed = np.union1d(first, np.flatnonzero(bound[0] >= least))
        return found(needed)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, key, score): for each row of queries (key, vector) its k nearest rows, itself left out; exact without ``probes``. Queries that are near
        each other are answered together, in blocks of at most QUERY_BYTES, each broadcast; a task keeps its best rows and those are merged."""
        asked = self.assigned(queries.select(F.col(self.key).cast("long").alias(self.key), F.col(self.vector).cast("array<double>").alias(self.vector)).where(F.col(self.key).isNotNull())).where("cell >= 0")
        dim = self.centroids().shape[1] or 1
        most = max(1, QUERY_BYTES // (8 * dim))
        blocks: list[tuple[int, int, int, int]] = []
        held = 0
        for r in asked.groupBy("cell").count().orderBy("cell").collect():  # a row a cell
            if blocks and held + r["count"] <= most:
                blocks[-1] = (blocks[-1][0], r.cell, 1, 0)
                held += r["count"]
            else:
                pieces = -(-r["count"] // most)
                blocks += [(r.cell, r.cell, pieces, p) for p in range(pieces)]
                held = r["count"] if pieces == 1 else most
        found = self.spark.createDataFrame([], f"query_id long, {self.key} long, score double")
        for low, high, pieces, p in blocks:
            rows = asked.where(F.col("cell").between(low, high) & (F.pmod(F.xxhash64(self.key), F.lit(pieces)) == p)).select(self.key, self.vector).collect()
            found = found.unionByName(self._answered(np.array([r[0] for r in rows], np.int64), units([r[1] for r in rows], dim)[1], k, probes))
        return found

    def probes_for(self, recall: float = 0.9, sample: int = 100, k: int = 10) -> int:
        """The fewest probes with which that share of the k nearest rows is found, measured by exact search for a sample of the stored rows."""
        rows = self.rows.read()
        asked = rows.where("cell >= 0").orderBy(F.xxhash64(self.key), self.key).limit(sample).select(self.key, self.vector)
        asked = {r[0]: r[1] for r in asked.collect()}  # ``sample`` rows
        queries = self.spark.createDataFrame(list(asked.items()), rows.select(self.key, self.vector).schema)
        hits = self.search_many(queries, k).join(rows.select(self.key, "cell"), self.key).select("query_id", "cell").collect()  # sample times k
        if not hits:
            return 1
        ids = sorted(asked)
        cells, middle, _ = self._bounds(units([asked[i] for i in ids])[1])
        rank = np.argsort(np.argsort(-middle, axis=1, kind="stable"), axis=1)
        column = {c: i for i, c in enumerate(cells.tolist())}
        places = np.sort([rank[ids.index(r.query_id), column[r.cell]] for r in hits])
        return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1

    def _answered(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int | None) -> DataFrame:
        cells, middle, bound = self._bounds(q)
        order = np.argsort(-middle, axis=1, kind="stable")
        first = order[:, : probes or max(1, round(math.sqrt(len(cells))))]
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, first, True, 1)
        near = self._scan(ids, q, cells, chosen, k)
        if probes is None:
            worst = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()  # a row a query of the block
            least = np.full(len(ids), -np.inf)
            place = {int(x): i for i, x in enumerate(ids)}
            for r in worst:
                least[place[r.query_id]] = r.least
            rest = ~chosen & (bound >= least[:, None])
            if rest.any():
                near = near.unionByName(self._scan(ids, q, cells, rest, k))
        return best_per_key(near, "query_id", [F.col("score").desc(), F.col(self.key)], k)

    def _scan(self, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, chosen: np.ndarray, k: int) -> DataFrame:
        by_cell = {int(cells[c]): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(0))}
        sent = self.spark.sparkContext.broadcast((ids, q, by_cell, k))
        rows = self.read(sorted(by_cell)).where(F.col(self.key).isNotNull()).select("cell", F.col(self.key).cast("long"), F.col(self.vector).cast("array<double>"))
        local = rows.mapInArrow(partial(_probed, sent, self.key), f"query_id long, {self.key} long, score double")
        return best_per_key(local, "query_id", [F.col("score").desc(), F.col(self.key)], k)
