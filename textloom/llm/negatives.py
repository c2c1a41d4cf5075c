"""Hard negatives by an inverted multi-index with certified windows.

Vectors are whole numbers (``quantised``) and a row's score is its exact inner product with the anchor. An anchor's positives are its best
other rows of its label; around each positive's score lies a window of scores, and the best rows of other labels inside it are its
negatives. Both are one search (``windowed_top``): the best ``k`` rows of the same or another label inside each of an anchor's windows.

* Index: two codebooks, one for each half of the components, are fitted by k-means on a bounded sample (``SAMPLE`` rows, ``SAMPLE_BYTES``);
  every row goes to the cell of its nearest words in both. A cell keeps how far its rows lie from either word, at most (its
  radii), and its rows in parts of ``PART_BYTES``, dealt by hash, so that a crowded cell is many parts.
* Traversal: anchors of one label travel in blocks, those of a cell and of the next ones together. A half's bound for a word is the largest, over the block's anchors, of the anchor's
  half-score with the word plus its half's length times the word's radius. A heap over pairs of sorted words visits cells by summed bounds,
  highest first (multi-sequence). A cell that can reach no window of any anchor, by its own radii, is passed over.
* Stop: a window is certified when it holds k rows and the next bound lies below the worst of them, or when that bound lies below the
  window. A block is done when all its windows are certified. Bounds hold for every row, so results are exact.
* Rounds: each round every open block asks for its next ``FIRST_CELLS * GROWTH**round`` cells; parts are counted through, up to ``SHELF`` of
  them are a shelf, and a request carries the block's anchors to a shelf once, with the places of the parts asked for there. A task holds one
  shelf at a time while its requests pass by, and returns only rows that enter a window's best so far; a block's finds are folded into its state, one
  row a block. States are tables; the driver sees only the codebooks and the cells' directory (at most ``MOST_WORDS**2`` rows), and how many
  blocks are open. Requests and states are never broadcast: as Parquet they are small for what they hold, since anchors recur in them.

Defined cases: rows with a null label, a null or empty vector, or any null or non-finite component take no part; vectors meet those of equal length
only; a null vec_id is no anchor and comes last in ties; rows with one vec_id are rows of their own (an anchor's copy can be its
positive), equal scores and ids in the order of the table's numbering; anchors without a positive or without a row in the window give no rows, nor
does an empty table; components are exact up to 2**53 / 256, scores while they fit a long; only vec_id, label and embedding are read,
so other columns may have any names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import numbered, written

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from 30 to 90 hundredths of the positive.
LOW, HIGH = 30, 90
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Rows a cell on average, and words of a codebook at most.
CELL_SIZE, MOST_WORDS = 256, 256
PART_BYTES, BLOCK_BYTES = 1 << 16, 1 << 14
#: Parts of a shelf at most, and how many shelves there are before any holds more than one.
SHELF, SHELVES = 16, 64
FIRST_CELLS, GROWTH = 4, 8
SEED = 20240131
NOBODY = np.iinfo(np.int64).max  # the id of a row without one
LEAST = np.iinfo(np.int64).min
VECTOR = "row long, vec_id long, label long, dim int, q binary, anchor boolean"
CODED = "row long, vec_id long, label long, dim int, q binary, anchor boolean, cell int, far_one double, far_two double"
PART = "dim int, shelf int, place int, rows binary, ids binary, labels binary, q binary"
STATE = "block long, dim int, rows binary, ids binary, labels binary, q binary, low binary, high binary, best binary, seen int, done boolean"
REQUEST = "block long, dim int, shelf int, places array<int>, anchors binary, labels binary, q binary, low binary, high binary"
FOUND = "block long, found binary"
Batches = Iterator[pa.RecordBatch]


@dataclass
class Directory:
    """Codebooks and cells of the vectors of one length."""

    one: np.ndarray
    two: np.ndarray
    #: by cell: rows (0 where there are none) and the two radii.
    count: np.ndarray
    far_one: np.ndarray
    far_two: np.ndarray
    part_rows: int
    #: Parts of a shelf.
    shelf: int = 1

    @property
    def half(self) -> int:
        return self.one.shape[1]

    def parts(self, cell):
        return -(-self.count[cell] // self.part_rows)

    @cached_property
    def first(self) -> np.ndarray:
        """By cell, the number of its first part; the parts of all cells are counted through."""
        return np.cumsum(self.parts(slice(None))) - self.parts(slice(None))

    def shelves(self, cells: list[int]) -> Iterator[tuple[int, list[int]]]:
        """The cells' parts, as places on their shelves."""
        asked = np.sort(np.concatenate([self.first[c] + np.arange(self.parts(c)) for c in cells])) if cells else np.zeros(0, np.int64)
        for shelf, places in itertools.groupby(asked.tolist(), key=lambda n: n // self.shelf):
            yield shelf, [n % self.shelf for n in places]


def quantised(x: list) -> np.ndarray:
    """floor(256 x) of each component, as whole numbers."""
    return np.clip(np.floor(256 * np.array(x, np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all."""
    for kind in ("<i2", "<i4"):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind).tobytes()
    return v.astype("<i8").tobytes()


def unpacked(data: bytes, dim: int, rows: int = 1) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (dim * rows)}").reshape(rows, dim).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; through floating point where no sum can leave its whole numbers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def _read(every: int, batches: Batches) -> Batches:
    """Rows (row, vec_id, label, embedding) that take part."""
    for batch in batches:
        out = []
        for row, vec_id, label, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if label is None or not x or None in x or not np.isfinite(np.array(x, np.float64)).all():
                continue
            out.append((row, NOBODY if vec_id is None else vec_id, label, len(x), packed(quantised(x)), vec_id is not None and vec_id % every == 0))
        if out:
            yield _table(list(zip(*out)), VECTOR)


def codebook(x: np.ndarray, words: int, steps: int = 12) -> np.ndarray:
    """k-means from a spread start (each new word the sample's farthest row from those before)."""
    center = x[np.random.default_rng(SEED).integers(len(x))][None]
    apart = ((x - center) ** 2).sum(1)
    while len(center) < words and apart.max() > 0:
        center = np.vstack([center, x[apart.argmax()]])
        apart = np.minimum(apart, ((x - center[-1]) ** 2).sum(1))
    for _ in range(steps):
        nearest = _nearest(x, center)
        n = np.bincount(nearest, minlength=len(center))
        sums = np.zeros_like(center)
        np.add.at(sums, nearest, x)
        center = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], center)
    return center


def _nearest(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return ((center**2).sum(1) - 2 * x @ center.T).argmin(1)


def _code(books: dict[int, Directory], batches: Batches) -> Batches:
    for batch in batches:
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            book = books[dim]
            v = np.vstack([unpacked(x, dim) for x in mine.column(4).to_pylist()]).astype(np.float64)
            one, two = v[:, : book.half], v[:, book.half :]
            i, j = _nearest(one, book.one), _nearest(two, book.two)
            far = [pa.array(np.linalg.norm(a - b, axis=1)) for a, b in ((one, book.one[i]), (two, book.two[j]))]
            yield pa.RecordBatch.from_arrays([*mine.columns, pa.array((i * len(book.two) + j).astype(np.int32)), *far], names=[c.split()[0] for c in CODED.split(", ")])


def _rows(batches: Batches) -> Iterator[tuple]:
    return itertools.chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))) for b in batches)


def _longs(values) -> bytes:
    return np.array(values, "<i8").tobytes()


def _pack_parts(books, batches: Batches) -> Batches:
    """Rows (dim, cell, part, row, vec_id, label, q), those of a part together and by vec_id and row: a row a part."""
    for (dim, cell, part), group in itertools.groupby(_rows(batches), key=lambda r: r[:3]):
        held = list(group)
        q = packed(np.vstack([unpacked(r[6], dim) for r in held]))
        shelf, place = divmod(int(books.value[dim].first[cell]) + part, books.value[dim].shelf)
        yield _table([[x] for x in (dim, shelf, place, _longs([r[3] for r in held]), _longs([r[4] for r in held]), _longs([r[5] for r in held]), q)], PART)


class Index:
    """The stored parts, and the directory of each length."""

    def __init__(self, vectors: DataFrame) -> None:
        """vectors: rows (VECTOR)."""
        spark = vectors.sparkSession
        sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}
        self.books: dict[int, Directory] = {}
        for dim, n in sizes.items():
            bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
            sample = vectors.where(F.col("dim") == dim).select(F.xxhash64("q", "row").alias("place"), "q").orderBy("place").limit(bound).collect()
            x = np.vstack([unpacked(r.q, dim) for r in sample]).astype(np.float64)
            words, half = max(1, min(MOST_WORDS, round(math.sqrt(n / CELL_SIZE)))), (dim + 1) // 2
            one, two = codebook(x[:, :half], words), codebook(x[:, half:], words)
            cells = len(one) * len(two)
            self.books[dim] = Directory(one, two, np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells), max(16, PART_BYTES // (2 * dim + 24)))
        sent = spark.sparkContext.broadcast(self.books)
        self.coded = written(vectors.mapInArrow(lambda b: _code(sent.value, b), CODED), "negatives-coded")
        told = self.coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far_one").alias("one"), F.max("far_two").alias("two"))
        for r in told.collect():  # at most MOST_WORDS**2 rows a length
            book = self.books[r.dim]
            book.count[r.cell], book.far_one[r.cell], book.far_two[r.cell] = r.n, r.one, r.two
        for book in self.books.values():
            book.shelf = int(min(SHELF, max(1, book.parts(slice(None)).sum() // SHELVES)))
        full = [(d, c, int(b.parts(c))) for d, b in self.books.items() for c in np.flatnonzero(b.count > b.part_rows).tolist()]
        many = F.broadcast(spark.createDataFrame(full, "dim int, cell int, parts int"))
        part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        dealt = self.coded.join(many, ["dim", "cell"], "left").select("dim", "cell", part, "row", "vec_id", "label", "q")
        shuffled = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "vec_id", "row")
        self.sent = spark.sparkContext.broadcast(self.books)
        self.parts = written(shuffled.mapInArrow(partial(_pack_parts, self.sent), PART), "negatives-parts")


def cells_by_bound(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of words (bound, i, j) by u[i] + v[j], highest first: a heap over both sorted sequences, where a pair enters when its neighbours
    towards the beginning have been taken."""
    by_u, by_v = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
    heap = [(-(u[by_u[0]] + v[by_v[0]]), 0, 0)]
    taken = [0] * len(by_u)  # how many pairs of each row of the grid are taken
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, by_u[a], by_v[b]
        taken[a] = b + 1
        if b + 1 < len(by_v) and (a == 0 or taken[a - 1] > b + 1):
            heapq.heappush(heap, (-(u[by_u[a]] + v[by_v[b + 1]]), a, b + 1))
        if a + 1 < len(by_u) and taken[a + 1] == b:
            heapq.heappush(heap, (-(u[by_u[a + 1]] + v[by_v[b]]), a + 1, b))


@dataclass
class Block:
    """Anchors with their windows, low to high, and each window's best rows so far: (score, vec_id, row), LEAST where there is none."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    best: np.ndarray

    @staticmethod
    def of(r: dict, k: int) -> Block:
        longs = lambda name: np.frombuffer(r[name], "<i8")
        rows = longs("rows")
        low = longs("low").reshape(len(rows), -1)
        return Block(rows, longs("ids"), longs("labels"), unpacked(r["q"], r["dim"], len(rows)), low, longs("high").reshape(low.shape), longs("best").reshape(*low.shape, k, 3))

    def needed(self) -> np.ndarray:
        """By anchor and window, the least score that still enters."""
        return np.maximum(self.low, self.best[:, :, -1, 0])

    def next_cells(self, book: Directory, seen: int, most: int) -> tuple[list[int], int, bool]:
        """The next cells to ask for, how many pairs of words are seen then, and whether none is left."""
        q = self.q.astype(np.float64)
        one, two = q[:, : book.half], q[:, book.half :]
        size_one, size_two = np.linalg.norm(one, axis=1)[:, None], np.linalg.norm(two, axis=1)[:, None]
        by_one, by_two = one @ book.one.T, two @ book.two.T
        shape = len(book.one), len(book.two)
        radius_one, radius_two = book.far_one.reshape(shape).max(1), book.far_two.reshape(shape).max(0)
        need, open_ = self.needed(), self.low <= self.high
        least = need[open_].min() if open_.any() else np.inf
        slack = 1e-9 * float((size_one * (np.linalg.norm(book.one, axis=1).max() + radius_one.max())).max() + (size_two * (np.linalg.norm(book.two, axis=1).max() + radius_two.max())).max()) + 1e-6
        found: list[int] = []
        place = 0
        for bound, i, j in cells_by_bound((by_one + size_one * radius_one).max(0), (by_two + size_two * radius_two).max(0)):
            if bound + slack < least:
                return found, place, True
            if len(found) == most:
                return found, place, False
            place += 1
            cell = i * shape[1] + j
            if place <= seen or not book.count[cell]:
                continue
            middle = by_one[:, i] + by_two[:, j]
            room = size_one[:, 0] * book.far_one[cell] + size_two[:, 0] * book.far_two[cell] + slack
            if (open_ & ((middle + room)[:, None] >= need) & ((middle - room)[:, None] <= self.high)).any():
                found.append(cell)
        return found, place, True

    def fold(self, found: np.ndarray) -> None:
        """found: rows (anchor's place, score, vec_id, row), each row of the table at most once an anchor."""
        k = self.best.shape[2]
        for w in range(self.low.shape[1]):
            at = found[:, 0]
            some = found[(found[:, 1] >= self.low[at, w]) & (found[:, 1] <= self.high[at, w])]
            old = self.best[:, w].reshape(-1, 3)
            old = np.hstack([np.repeat(np.arange(len(self.rows)), k)[:, None], old])
            both = np.vstack([old[old[:, 1] > LEAST], some])
            both = both[np.lexsort((both[:, 3], both[:, 2], -both[:, 1], both[:, 0]))]
            n = np.bincount(both[:, 0], minlength=len(self.rows))
            rank = np.arange(len(both)) - np.repeat(n.cumsum() - n, n)
            kept = rank < k
            self.best[:, w] = LEAST
            self.best[both[kept, 0], w, rank[kept]] = both[kept, 1:]


def _ask(books, most: int, k: int, batches: Batches) -> Batches:
    """Requests of each open block for its next cells, and a row with shelf -1 (-2 when none is left) that tells in places how far it is then."""
    for r in itertools.chain.from_iterable(b.to_pylist() for b in batches):
        book, block = books.value[r["dim"]], Block.of(r, k)
        cells, seen, done = block.next_cells(book, r["seen"], most)
        keep = [r["block"], r["dim"]]
        out = [(*keep, -2 if done else -1, [seen], None, None, None, None, None)]
        sent = (r["rows"], r["labels"], r["q"], _longs(block.needed()), r["high"])
        out += [(*keep, shelf, places, *sent) for shelf, places in book.shelves(cells)]
        for i in range(0, len(out), 256):
            yield _table(list(zip(*out[i : i + 256])), REQUEST)


def _enters(same: bool, k: int, request: dict, part: tuple) -> np.ndarray:
    """The rows of a part that enter a window: (anchor's place, score, vec_id, row)."""
    longs = lambda name: np.frombuffer(request[name], "<i8")
    anchors, (rows, ids, labels, q) = longs("anchors"), part
    s = scores(unpacked(request["q"], request["dim"], len(anchors)), q)
    fits = (longs("labels")[:, None] == labels) == same
    fits &= anchors[:, None] != rows
    low, high = longs("low").reshape(len(anchors), -1), longs("high").reshape(len(anchors), -1)
    enters = np.zeros(s.shape, bool)
    for w in range(low.shape[1]):
        here = fits & (s >= low[:, w : w + 1]) & (s <= high[:, w : w + 1])
        crowded = np.flatnonzero(here.sum(1) > k)
        if len(crowded):  # the k best: by score, then place, which follows vec_id and row
            order = np.argsort(np.where(here[crowded], -s[crowded], NOBODY), axis=1, kind="stable")[:, :k]
            here[crowded] = False
            here[crowded[:, None], order] = True
        enters |= here
    i, j = np.nonzero(enters)
    return np.stack([i, s[i, j], ids[j], rows[j]], 1).astype("<i8")


def _score(same: bool, k: int, batches: Batches) -> Batches:
    """Parts and requests, those of a shelf together and its parts first: the rows that enter a window."""
    for _, group in itertools.groupby(itertools.chain.from_iterable(b.to_pylist() for b in batches), key=lambda r: (r["dim"], r["shelf"])):
        held = {}
        for r in group:
            if r["places"] is None:
                rows, ids, labels = (np.frombuffer(r[name], "<i8") for name in ("rows", "ids", "labels"))
                held[r["place"]] = rows, ids, labels, unpacked(r["q"], r["dim"], len(rows))
                continue
            found = np.vstack([_enters(same, k, r, held[place]) for place in r["places"]])
            if len(found):
                yield _table([[r["block"]], [found.tobytes()]], FOUND)


def _fold(k: int, batches: Batches) -> Batches:
    """States (found null) and finds, those of a block together and its state first: new states. ``seen`` and ``done`` come as the round's own rows."""
    for _, group in itertools.groupby(itertools.chain.from_iterable(b.to_pylist() for b in batches), key=lambda r: r["block"]):
        state = next(group)
        block, held, size = Block.of(state | {"best": bytearray(state["best"])}, k), [], 0
        for r in group:
            held.append(np.frombuffer(r["found"], "<i8").reshape(-1, 4))
            size += len(held[-1])
            if size > 1 << 17:
                block.fold(np.vstack(held))
                held, size = [], 0
        if held:
            block.fold(np.vstack(held))
        yield _table([[state[c.split()[0]]] if c.split()[0] != "best" else [block.best.tobytes()] for c in STATE.split(", ")], STATE)


def met(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with the parts of their shelf: both are dealt by shelf, and a shelf's parts come first."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = stored.unionByName(asked.where("shelf >= 0"), allowMissingColumns=True)
    return both.repartition(parts, "dim", "shelf").sortWithinPartitions("dim", "shelf", F.col("places").isNotNull())


def windowed_top(index: Index, states: DataFrame, same: bool, k: int) -> DataFrame:
    """states (rows of STATE, their windows open) with the best k rows of each window, of the anchor's label or of others."""
    spark = states.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finished, left, most = [], states, FIRST_CELLS
    while True:
        asked = written(left.mapInArrow(partial(_ask, index.sent, most, k), REQUEST), "negatives-asked")
        found = met(asked, index.parts).mapInArrow(partial(_score, same, k), FOUND)
        far = asked.where("shelf < 0").select("block", F.col("places")[0].alias("now"), (F.col("shelf") == -2).alias("ended"))
        before = left.hint("merge").join(far, "block").select(*[F.col("now").alias("seen") if c == "seen" else F.col("ended").alias("done") if c == "done" else F.col(c) for c in left.columns], F.lit(None).cast("binary").alias("found"))
        both = before.unionByName(found, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", F.col("found").isNotNull())
        now = written(both.mapInArrow(partial(_fold, k), STATE), "negatives-state")
        finished.append(now.where("done"))
        left = now.where("not done")
        if left.isEmpty():
            break
        most *= GROWTH
    out = finished[0]
    for table in finished[1:]:
        out = out.unionByName(table)
    return out


def _start(k: int, batches: Batches) -> Batches:
    """Anchors (dim, label, cell, row, vec_id, q) in order: blocks with one window for all scores."""
    for (dim, label), group in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
        most = max(1, BLOCK_BYTES // (2 * dim + 128))
        while held := list(itertools.islice(group, most)):
            n = len(held)
            rows = np.array([r[3] for r in held], np.int64)
            columns = [int(rows[0]), dim, _longs(rows), _longs([r[4] for r in held]), _longs([label] * n), packed(np.vstack([unpacked(r[5], dim) for r in held]))]
            columns += [_longs([LEAST + 1] * n), _longs([NOBODY] * n), np.full((n, 1, k, 3), LEAST, "<i8").tobytes(), 0, False]
            yield _table([[c] for c in columns], STATE)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _windows(low: int, high: int, before: int, k: int, batches: Batches) -> Batches:
    """States with each anchor's positives: states whose windows lie under them, and the positives beside them."""
    for r in itertools.chain.from_iterable(b.to_pylist() for b in batches):
        best = np.frombuffer(r["best"], "<i8").reshape(-1, before, 3)
        n = len(best)
        windows = np.array([window(s, low, high) if s > LEAST else (NOBODY, LEAST) for s in best[:, :, 0].ravel().tolist()], "<i8").reshape(n, before, 2)
        r |= {"low": windows[:, :, 0].tobytes(), "high": windows[:, :, 1].tobytes(), "best": np.full((n, before, k, 3), LEAST, "<i8").tobytes(), "seen": 0, "done": False}
        yield _table([[r[c.split()[0]]] for c in STATE.split(", ")], STATE)


TOLD = "anchor_id long, anchor_row long, place int, rank int, other_id long, score long"


def _tell(k: int, batches: Batches) -> Batches:
    for r in itertools.chain.from_iterable(b.to_pylist() for b in batches):
        rows, ids = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8")
        best = np.frombuffer(r["best"], "<i8").reshape(len(rows), -1, k, 3)
        a, w, i = np.nonzero(best[:, :, :, 0] > LEAST)
        if len(a):
            got = best[a, w, i]
            other = pa.array(got[:, 1], mask=got[:, 1] == NOBODY)
            columns = [pa.array(ids[a]), pa.array(rows[a]), pa.array(w.astype(np.int32)), pa.array((i + 1).astype(np.int32)), other, pa.array(got[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOLD.split(", ")])


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors among embeddings (vec_id, label,
    embedding): the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    raw, row = numbered(embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")), "negatives-rows")
    vectors = written(raw.select(row, "vec_id", "label", "embedding").mapInArrow(partial(_read, every), VECTOR), "negatives-vectors")
    index = Index(vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "label", "cell", "row"]
    anchors = index.coded.where("anchor").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dim", "label", "cell", "row", "vec_id", "q")
    start = written(anchors.mapInArrow(partial(_start, positives), STATE), "negatives-anchors")
    near = written(windowed_top(index, start, True, positives), "negatives-positives")
    far = windowed_top(index, written(near.mapInArrow(partial(_windows, low, high, positives, negatives), STATE), "negatives-windows"), False, negatives)
    first = near.mapInArrow(partial(_tell, positives), TOLD).select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    second = far.mapInArrow(partial(_tell, negatives), TOLD)
    return second.hint("merge").join(first, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
