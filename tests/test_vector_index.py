"""The vector index: exact against all rows, recall of probes, files read, upserts and deletes by cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import search as S
from textloom.operators.vector_index import NOWHERE, VectorIndex

SCHEMA = "vec_id long, label int, embedding array<float>"


def crowds(n=3000, dim=16, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    v = centers[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dim))
    return [(i, int(i % 4), x.tolist()) for i, x in enumerate(v.astype(np.float32))]


ODD = [(5000, 1, None), (5001, 1, []), (5002, 1, [0.0] * 16), (5003, 1, [1.0, 2.0]), (5004, 1, [float("nan")] * 16), (None, 1, [1.0] * 16)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "v")
    spark.createDataFrame(crowds() + ODD, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, f"file://{tmp_path_factory.mktemp('ix')}/i", file_rows=100).build(vectors)


def exact(vectors, queries, k):
    return sorted(map(tuple, S.nearest_of_many(queries, vectors, k, group=None).select("query_id", "vec_id", "score").collect()))


def test_exact_searches(index, vectors):
    q = [float(x) for x in crowds()[7][2]]
    for where in (None, F.col("label") == 2):
        assert sorted(map(tuple, index.search(q, 10, where=where).collect())) == sorted(map(tuple, S.nearest(vectors, q, 10, where=where).collect()))
    queries = vectors.where("vec_id % 20 = 0 and vec_id < 3000")
    assert sorted(map(tuple, index.search_many(queries, 10).collect())) == exact(vectors.where("vec_id < 3000"), queries, 10)


def test_few_cells_find_nearly_all(index, vectors):
    queries = vectors.where("vec_id % 20 = 0 and vec_id < 3000")
    wanted = {x[:2] for x in exact(vectors.where("vec_id < 3000"), queries, 10)}
    cells = len(index.directory())
    probes = index.probes_for(0.9)
    got = {(r.query_id, r.vec_id) for r in index.search_many(queries, 10, probes).collect()}
    assert cells > 40 and probes <= cells // 5 and len(got & wanted) / len(wanted) >= 0.88
    assert len({(r.query_id, r.vec_id) for r in index.search_many(queries, 10, 2 * probes).collect()} & wanted) / len(wanted) >= 0.9


def test_searches_read_the_files_of_their_cells(index):
    told = index.directory()
    all_files = len(index.rows.snapshot().files)
    probed = sorted(c for c in told if c >= 0)[:3]
    assert all_files >= 30 and index.files(probed) <= 8
    read = index.read(probed)
    assert len(read.inputFiles()) == index.files(probed) and read.count() == sum(told[c][0] for c in probed)
    q = [float(x) for x in crowds()[7][2]]
    assert len(index.search(q, 10).inputFiles()) < all_files // 2  # exact, and still few
    assert told[NOWHERE][0] == 5


def test_upserts_and_deletes(spark, vectors, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i", file_rows=100).build(vectors)
    moved = spark.createDataFrame([(i, 9, (-np.array(v)).tolist()) for i, _, v in crowds()[:40]], SCHEMA)
    before = set(index.rows.snapshot().files)
    index.delete(spark.createDataFrame([(i,) for i in range(2000, 2050)], "vec_id long"))
    index.upsert(moved)
    now = vectors.where("vec_id >= 40 and vec_id < 2000 or vec_id >= 2050 and vec_id < 3000").unionByName(moved)
    queries = now.where("vec_id % 20 = 0")
    assert sorted(map(tuple, index.search_many(queries, 5).collect())) == exact(now, queries, 5)
    assert before & set(index.rows.snapshot().files)  # files without such rows are left alone
    assert index.rows.read().where("vec_id = 3").count() == 1


def test_empty_and_tiny_tables(spark, tmp_path):
    none = VectorIndex(spark, f"file://{tmp_path}/none").build(spark.createDataFrame([], SCHEMA))
    assert none.search([1.0, 0.0], 3).count() == 0 and none.search_many(spark.createDataFrame([(1, 1, [1.0, 0.0])], SCHEMA), 3).count() == 0
    one = VectorIndex(spark, f"file://{tmp_path}/one").build(spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0])], SCHEMA))
    assert [tuple(r) for r in one.search([2.0, 0.0], 3).collect()] == [(1, 1.0), (2, 1.0)]
    assert [tuple(r) for r in one.search_many(spark.createDataFrame([(1, 1, [3.0, 0.0])], SCHEMA), 3).collect()] == [(1, 2, 1.0)]
