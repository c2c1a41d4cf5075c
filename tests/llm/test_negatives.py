"""Hard negatives against all scores."""

import numpy as np
import pytest

from textloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def by_hand(rows, every=100, low=30, high=90):
    rows = [r for r in rows if r[1] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all()]
    q = [[int(np.floor(256 * x)) for x in r[2]] for r in rows]
    key = lambda i: negatives.NOBODY if rows[i][0] is None else rows[i][0]
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in range(len(rows)) if i != a and len(q[i]) == len(q[a])}
        order = sorted(score, key=lambda i: (-score[i], key(i), i))
        for p in [i for i in order if rows[i][1] == label][:5]:
            found = [i for i in order if rows[i][1] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(anchor, rows[p][0], k + 1, rows[i][0], score[p], score[i]) for k, i in enumerate(found[:10])]
    return sorted(out, key=str)


def vectors(n, dim, seed, crowd=0.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    made = []
    for i in range(n):
        v = centers[0] + 1e-3 * rng.normal(size=dim) if rng.random() < crowd else centers[rng.integers(6)] + rng.normal(size=dim)
        made.append((i, int(rng.integers(4)), (v / np.linalg.norm(v) if dim > 1 else v).tolist()))
    return made


@pytest.mark.parametrize("dim,crowd,cell", [(7, 0.4, 8), (64, 0.0, 64), (1, 0.0, 16)])
def test_against_all_scores(spark, monkeypatch, dim, crowd, cell):
    monkeypatch.setattr(negatives, "CELL_SIZE", cell)
    monkeypatch.setattr(negatives, "PART_BYTES", 40 * (2 * dim + 24))
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    rows = vectors(500, dim, dim, crowd)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20)
    wanted = by_hand(rows, 20)
    assert wanted and sorted(map(tuple, got.collect()), key=str) == wanted


def test_odd_rows(spark):
    base = vectors(120, 4, 1)
    odd = [(7, None, [1.0] * 4), (8, 1, None), (9, 1, []), (10, 1, [1.0, None, 0.0, 0.0]), (11, 1, [float("nan"), 0.0, 0.0, 0.0]), (None, 2, [0.5] * 4), (0, base[0][1], base[0][2]), (5, 3, base[5][2]), (20, 2, [0.1, 0.2]), (21, 2, [0.3, 0.1]), (22, 1, [0.2, 0.1]), (40, 1, [-3e4, 2e5, 1.0, 1e6]), (41, 1, [2e4, 2e5, 1.0, 1e6]), (42, 0, [1e4, 1e5, 0.0, 0.5e6])]
    rows = base + odd
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).coalesce(1).selectExpr("*", "1 as row", "2 as cell", "3 as q"), every=10)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, 10)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0, 2.0])], SCHEMA)).count() == 0


def test_cells_come_by_bound():
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 9, 13).astype(float), rng.normal(size=7)
    seen = list(negatives.cells_by_bound(u, v))
    assert len({(i, j) for _, i, j in seen}) == len(u) * len(v) and all(b == u[i] + v[j] for b, i, j in seen)
    assert [b for b, _, _ in seen] == sorted((b for b, _, _ in seen), reverse=True)


def test_traversal_stops_before_the_end():
    """Two far-apart crowds: anchors of one are certified without a cell of the other."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(400, 8)) * 3 + 400, rng.normal(size=(400, 8)) * 3 - 400]).astype(np.int64)
    one, two = negatives.codebook(x[:, :4].astype(float), 8), negatives.codebook(x[:, 4:].astype(float), 8)
    i, j = negatives._nearest(x[:, :4], one), negatives._nearest(x[:, 4:], two)
    cell = i * 8 + j
    far_one, far_two = np.linalg.norm(x[:, :4] - one[i], axis=1), np.linalg.norm(x[:, 4:] - two[j], axis=1)
    radius = lambda far: np.array([far[cell == c].max(initial=0) for c in range(64)])
    book = negatives.Directory(one, two, np.bincount(cell, minlength=64), radius(far_one), radius(far_two), 100)
    s = x[:400] @ x[0]
    best = np.full((1, 1, 5, 3), 0)
    best[0, 0, :, 0] = np.sort(s)[::-1][:5]
    block = negatives.Block(np.array([0]), np.array([0]), np.array([1]), x[:1], np.array([[negatives.LEAST + 1]]), np.array([[negatives.NOBODY]]), best)
    cells, _, done = block.next_cells(book, 0, 10_000)
    assert done and set(cells) <= set(cell[:400].tolist()) and len(cells) < len(set(cell.tolist()))
    assert set(cell[:400][s >= np.sort(s)[-5]].tolist()) <= set(cells)
