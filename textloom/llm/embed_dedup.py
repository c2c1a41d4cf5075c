"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors with one label link when their cosine is at least ``least``. Equal vectors become one representative first, so
copies cost nothing further and a link between representatives counts for all copies behind them.

* Codes: unit vectors are turned by random orthogonal matrices (seeded), as many as give ``SIGNS`` coordinates or more; together they
  keep inner products. A code holds the coordinates' signs; stored with it is the correction factor f, the inner product of the
  code's own unit vector with the turned vector.
* Meeting: a sign differs in a pair at angle a with chance a / pi. Each of several tables reads ``bits`` of the signs, chosen at random, and
  vectors of one label that agree in them meet in a cell. ``bits`` grows with the logarithm of a label's vectors; the number of tables is
  the least with which a pair at the threshold meets nowhere with a chance of at most ``MISS`` (``tables_for`` sums over how many signs
  may differ); closer pairs miss less. Tables grow slowly with a label's vectors, whatever
  their dimension: 12 at 500, 20 at 4,000, 32 at 65,000, 68 at 4 million, 108 at 64 million and beyond (512 signs). A pair counts in the first table in which it meets.
* Only codes, factors and vectors in one byte a component travel to the cells. Of the pairs that meet, an estimate decides which need
  their vectors: the inner product of one side's code with the other side's turned byte vector, over the code's factor. It is free of bias over the
  turns. For a true value c its error is sqrt(1 - c^2) / f times the code's inner product with a unit direction across the vector, of which,
  given f, every turn makes one of dim - 1 coordinates of a random direction: below -t * sqrt(1 - f^2) / sqrt(turns * (dim - 1)) with a chance of at
  most exp(-t^2 / 2). What the bytes lose adds at most their error's length over f. Pairs whose estimate lies below what a pair at the threshold
  falls under with chance ``DOUBT`` are dropped; for the others alone the vectors are fetched.
* The same estimate picks the pairs again beside the vectors, and those are computed anew in double precision from the vectors as given. So a
  linking pair is lost with a chance of at most MISS + 2 * DOUBT (either side can be the code's), and no other pair links.
* Cells of more than a block are cut into blocks and each pair of blocks is a task of its own. Tasks return, for each vector, how many
  rows it links with and one star of the links, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link
with nothing; components of any finite size are read (a vector is scaled by a power of two, which changes no cosine); vectors of one
label but unlike lengths don't link; rows with one vec_id, or with none, are rows of their own, and a null vec_id counts as a
component's smallest only where there is no other; an empty table gives no rows; only vec_id, embedding and label are read, so
other columns may have any names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.scratch import written
from textloom.llm.simhash import stars

LEAST = 0.98
MISS, DOUBT = 1e-8, 1e-9
SIGNS = 512
#: Vectors of a label for each cell of a table, at most bits, and the largest blocks with codes and with vectors.
CELL_SIZE = 64
MOST_BITS = 20
CODE_BLOCK, BLOCK = 4096, 1024
SEED = 20240101
#: Labels up to this many are broadcast with their counts; more are joined by shuffle.
BROADCAST_LABELS = 1 << 16
VECTOR = "row long, vec_id long, label long, dim int, vector binary"
CODE = "label long, dim int, rep long, n long, bits int, code binary, factor double, short binary, scale double, loss double, vector binary"
CELL = "label long, dim int, cell long, bits int, rep long, code binary, factor double, short binary, scale double, loss double"
NEEDED = "label long, dim int, cell long, rep long"
MET = "rep long, weight long, root long"


@cache
def rotation(dim: int) -> np.ndarray:
    """Orthogonal matrices side by side, scaled so that inner products are kept."""
    rng = np.random.default_rng(SEED + dim)
    found = []
    for _ in range(turns(dim)):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.hstack(found) / math.sqrt(turns(dim))


@cache
def tables_for(bits: int, signs: int, least: float, miss: float = MISS) -> int:
    """The number of tables with which a pair at the threshold fails to meet with chance ``miss`` at most."""
    chance = math.acos(least) / math.pi
    odds = [math.exp(math.lgamma(signs + 1) - math.lgamma(d + 1) - math.lgamma(signs - d + 1) + d * math.log(chance) + (signs - d) * math.log1p(-chance)) for d in range(signs + 1)]
    apart = np.array([1 - math.prod((signs - d - i) / (signs - i) for i in range(bits)) if d + bits <= signs else 1.0 for d in range(signs + 1)])
    tables = 1
    while np.dot(odds, apart**tables) > miss and tables < 4096:
        tables += 1
    return tables


def turns(dim: int) -> int:
    return -(-SIGNS // dim)


def least_estimate(factor: np.ndarray, loss: np.ndarray, dim: int, least: float, doubt: float = DOUBT) -> np.ndarray:
    """For each code (factor) and each byte vector (loss), the estimate under which a pair at the threshold falls with chance ``doubt`` at most."""
    f = np.minimum(factor, 1.0)
    free = turns(dim) * (dim - 1)
    spread = np.sqrt(1 - f * f) / f * math.sqrt(max(0.0, 1 - least * least)) * (math.sqrt(2 * math.log(1 / doubt) / free) if free else np.inf)
    return least - np.nan_to_num(spread, nan=np.inf)[:, None] - loss[None, :] / f[:, None] - 1e-9


def shortened(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in one byte a component: bytes, scales, and the lengths of what is lost."""
    scale = np.abs(units).max(1) / 127
    short = np.rint(units / scale[:, None]).astype(np.int8)
    return short, scale, np.linalg.norm(units - short * scale[:, None], axis=1)


@cache
def places(bits: int, signs: int, least: float) -> np.ndarray:
    """For each table, the signs that it reads."""
    rng = np.random.default_rng(SEED + 64 * signs + bits)
    return np.stack([rng.permutation(signs)[:bits] for _ in range(tables_for(bits, signs, least))])


def keys(code: np.ndarray, bits: int, least: float) -> np.ndarray:
    """Keys of the codes (rows of 0 and 1) in every table."""
    at = places(bits, code.shape[1], least)
    out = np.zeros((len(code), len(at)), np.int64)
    for i in range(bits):
        out |= code[:, at[:, i]].astype(np.int64) << i
    return out


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    named = [c.split() for c in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), named)], names=[n for n, _ in named])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link as bytes of their doubles; null for the others."""
    for batch in batches:
        dims, kept = [], []
        for label, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            v = None
            if label is not None and x and None not in x:
                v = np.array(x, "<f8")
                v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) if np.isfinite(v).all() and v.any() else None
            dims.append(0 if v is None else len(v))
            kept.append(None if v is None else (v + 0.0).tobytes())  # no negative zero
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(dims, pa.int32()), pa.array(kept, pa.binary())], names=["row", "vec_id", "label", "dim", "vector"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, vector, rep, n, bits): with each vector's code and factor, and itself in bytes."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            unit = np.frombuffer(b"".join(mine.column(2).to_pylist()), "<f8").reshape(-1, dim)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            y = unit @ rotation(dim)
            code = [x.tobytes() for x in np.packbits(y > 0, axis=1, bitorder="little")]
            factor = np.abs(y).sum(1) / math.sqrt(y.shape[1])
            short, scale, loss = shortened(unit)
            bits = np.minimum(mine.column(5).to_numpy(), y.shape[1]).astype(np.int32)
            columns = [mine.column(0), mine.column(1), mine.column(3), mine.column(4), pa.array(bits), pa.array(code, pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(scale), pa.array(loss), mine.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CODE.split(", ")])


def _unpacked(codes: list[bytes], signs: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")[:, :signs]


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(9))), key=lambda r: (r[1], r[3]))
            for (dim, bits), group in itertools.groupby(rows, key=lambda r: (r[1], r[3])):
                held = list(group)
                for i in range(0, len(held), 512):
                    some = held[i : i + 512]
                    key = keys(_unpacked([r[4] for r in some], rotation(dim).shape[1]), bits, least)
                    for (label, _, rep, _, *rest), mine in zip(some, (key | np.arange(key.shape[1]) << MOST_BITS).tolist()):
                        out += [(label, dim, cell, bits, rep, *rest) for cell in mine]
                    if len(out) > 20_000:
                        yield _batch(out, CELL)
                        out = []
            if out:
                yield _batch(out, CELL)

    return run


def _first_meeting(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs (i of one, j of two), given by their keys, meet in no table before ``table``."""
    return ~(one[i, :table] == two[j, :table]).any(1)


def side(codes: list[bytes], factors: list[float], shorts: list[bytes], scales: list[float], losses: list[float], dim: int) -> dict:
    """What the estimate needs of some vectors: codes as rows of 0 and 1, factors, byte vectors turned, and their losses."""
    short = np.frombuffer(b"".join(shorts), np.int8).reshape(len(codes), dim)
    return {"dim": dim, "code": _unpacked(codes, rotation(dim).shape[1]), "factor": np.array(factors), "y": (short * np.array(scales)[:, None]) @ rotation(dim), "loss": np.array(losses)}


def open_pairs(a: dict, b: dict | None, table: int, bits: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of pairs that meet first in this table and whose estimate doesn't rule out a link; without b the pairs inside a."""
    other = a if b is None else b
    signs = a["code"].shape[1]
    one = keys(a["code"], bits, least)
    two = one if b is None else keys(other["code"], bits, least)
    y = other["y"].T.astype(np.float32)
    for s in range(0, len(one), 512):
        some = slice(s, s + 512)
        estimate = ((a["code"][some].astype(np.float32) * 2 - 1) @ y) / (math.sqrt(signs) * a["factor"][some, None])
        i, j = np.nonzero(estimate >= least_estimate(a["factor"][some], other["loss"], a["dim"], least) - 1e-5)
        i += s
        if b is None:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 16):
            p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            new = _first_meeting(one, two, p, q, table)
            yield p[new], q[new]


def linked(a: dict, b: dict | None, table: int, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of pairs that link and meet first in this table, by the vectors of those that the estimate leaves open."""
    v, w = a["v"], (a if b is None else b)["v"]
    size_v, size_w = np.linalg.norm(v, axis=1), np.linalg.norm(w, axis=1)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in open_pairs(a, b, table, bits, least):
        for s in range(0, len(i), 1 << 14):
            p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            keep = np.einsum("ij,ij->i", v[p], w[q]) / (size_v[p] * size_w[q]) >= least
            found_i.append(p[keep])
            found_j.append(q[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _by_group(process, shape: str):
    """Runs process over the rows of each (label, dim, cell, p, q), which come together; p and q are the blocks, and own the row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))) for b in batches)
        out: list[tuple] = []
        for (_, _, _, p, q), group in itertools.groupby(rows, key=lambda r: r[:5]):
            held = list(group)
            if p == q:
                out += process(held, None) if len(held) > 1 else []
            else:
                one, two = [r for r in held if r[5] == p], [r for r in held if r[5] == q]
                out += process(one, two) if one and two else []
            if len(out) > 20_000:
                yield _batch(out, shape)
                out = []
        if out:
            yield _batch(out, shape)

    return run


def _side(rows: list[tuple], at: int) -> dict:
    """Of rows whose columns from ``at`` on are code, factor, short, scale and loss."""
    return side(*([r[at + k] for r in rows] for k in range(5)), rows[0][1])


def _screen(least: float):
    """Rows (label, dim, cell, p, q, own, bits, rep, code, factor, short, scale, loss): those with a pair that may link."""

    def process(one: list[tuple], two: list[tuple] | None) -> list[tuple]:
        label, dim, cell, bits = *one[0][:3], one[0][6]
        other = one if two is None else two
        wanted = set()
        for i, j in open_pairs(_side(one, 8), None if two is None else _side(two, 8), cell >> MOST_BITS, bits, least):
            wanted |= {one[k][7] for k in np.unique(i).tolist()} | {other[k][7] for k in np.unique(j).tolist()}
        return [(label, dim, cell, rep) for rep in wanted]

    return _by_group(process, NEEDED)


def _meet(least: float):
    """Rows (label, dim, cell, p, q, own, bits, rep, n, code, factor, short, scale, loss, vector): links of each vector, and stars."""

    def process(one: list[tuple], two: list[tuple] | None) -> list[tuple]:
        _, dim, cell, bits = *one[0][:3], one[0][6]
        whole = lambda rows: _side(rows, 9) | {"v": np.frombuffer(b"".join(r[14] for r in rows), "<f8").reshape(len(rows), dim)}
        i, j = linked(whole(one), None if two is None else whole(two), cell >> MOST_BITS, bits, least)
        if not len(i):
            return []
        ordered = one if two is None else one + two
        j = j if two is None else j + len(one)
        n = np.array([r[8] for r in ordered])
        weight = np.zeros(len(ordered), np.int64)
        np.add.at(weight, i, n[j])
        np.add.at(weight, j, n[i])
        root = np.arange(len(ordered))
        node, to = stars(len(ordered), i, j)
        root[node] = to
        return [(ordered[k][7], int(weight[k]), ordered[root[k]][7]) for k in np.flatnonzero(weight)]

    return _by_group(process, MET)


def _dealt(cells: DataFrame, block: int, *columns: str) -> DataFrame:
    """Rows of each cell together; of cells with more than ``block`` rows each pair of blocks."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["label", "dim", "cell"]
    large = cells.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = cells.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *columns)
    return dealt.repartition(parts, *key, "p", "q").sortWithinPartitions(*key, "p", "q")


def near_vectors(embeddings: DataFrame, least: float = LEAST, code_block: int = CODE_BLOCK, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of embeddings (vec_id, embedding, label)."""
    raw = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    vectors = written(raw.mapInArrow(_read, VECTOR), "vectors")
    can = vectors.where("vector is not null")
    groups = written(can.groupBy("label", "vector").agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim")), "vector-groups")
    bits = F.ceil(F.log2(F.count("*") / CELL_SIZE))
    sizes = groups.groupBy("label").agg(F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), bits)).cast("int").alias("bits"))
    if sizes.count() <= BROADCAST_LABELS:
        sizes = F.broadcast(sizes)
    codes = written(groups.join(sizes, "label").select("label", "dim", "vector", "rep", "n", "bits").mapInArrow(_codes, CODE), "vector-codes")
    told = ["code", "factor", "short", "scale", "loss"]
    cells = written(codes.select("label", "dim", "rep", "bits", *told).mapInArrow(_cells(least), CELL), "vector-cells")
    needed = written(_dealt(cells, code_block, "bits", "rep", *told).mapInArrow(_screen(least), NEEDED).distinct(), "vector-needed")
    fetched = needed.join(codes.select("rep", "n", "bits", *told, "vector"), "rep")
    met = written(_dealt(fetched, block, "bits", "rep", "n", *told, "vector").mapInArrow(_meet(least), MET), "vector-links")
    weights = met.groupBy("rep").agg(F.sum("weight").alias("weight"))
    roots = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    told = groups.join(weights, "rep", "left").join(roots, "rep", "left").select("label", "vector", (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    linked_rows = written(can.join(told, ["label", "vector"]).select("vec_id", "n_links", "root"), "vector-members")
    first = linked_rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = vectors.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked_rows.join(first, "root").select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
