"""SimHash near-dedup with a Gray-order hierarchical index.

A document's words (A-Z lower-cased, between characters of [\\x20\\x09-\\x0D]) give shingles of three; a bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42). Fewer words give one shingle, none
give fingerprint zero. Documents link when their fingerprints differ in 3 bits or fewer.

Equal fingerprints become one code first, so copies cost nothing further. Of codes that differ in at most 3 bits, one at
least of four 16-bit blocks is equal: the codes are stored four times, turned so that each block leads in one of them,
and sorted by the Gray rank of the turned code. Codes with one leading block lie together in that order, neighbours
differ in few bits, and a range partitioning of it is even, as ranks are distinct.

In each range, runs with one leading block get an index of two upper levels: a node holds the bits that all codes below
it share (mask and pattern), less those that its parent already holds. A search adds up the differences on the way down
and leaves a node, with all its codes, once they pass 3. Runs that cross the ranges' ends or are longer than ``segment``
are cut into segments; pairs of segments of one block are compared by the bits that each shares before their codes meet.
A pair counts where its first equal block leads. Links leave a task as stars of what it has joined, at most one row a
code.

Defined cases: null and empty texts have fingerprint zero and link with each other; null doc_ids keep their fingerprint
and component; repeated rows are all returned; an empty table gives no rows; very long texts are read whole, their shingles' hashes
counted some thousands at a time; columns of any name ride along in ``drop_near_copies``, and only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.scratch import numbered, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = DISTANCE + 1
FANOUT = 16
SEGMENT = 2048
#: Lists of up to this many row numbers (8 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 20
FOUND = "a long, b long, turn int, block int, segment long, shared long, pattern long, codes array<long>"


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = (sizes + 1).cumsum() - 1
    starts, ends = (ends - sizes)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    counts = sum(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for x in np.array_split(h, len(h) // 8192 + 1))
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, code) of each document; code holds the fingerprint as a signed long. row numbers the documents; it is
    computed once here, as the codes are written."""
    row = F.monotonically_increasing_id() if row is None else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_signed(fingerprint(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.int64())], names=["row", "doc_id", "code"])

    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(run, "row long, doc_id long, code long"), "simhash-fingerprints")


def turned(codes: np.ndarray, turn: int) -> np.ndarray:
    """Codes with block ``turn`` leading."""
    bits = np.uint64(64 // BLOCKS * turn)
    return codes if not turn else (codes << bits) | (codes >> (np.uint64(64) - bits))


def _gray_rank(code, turn):
    """The turned code's rank in Gray order, its sign bit flipped so that signed order is the ranks' order."""
    x = F.expr(f"(code << ({64 // BLOCKS} * turn)) | (case when turn = 0 then 0L else shiftrightunsigned(code, 64 - {64 // BLOCKS} * turn) end)")
    for by in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _levels(codes: np.ndarray, runs: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of codes in Gray order, cut at ``runs`` (the runs' starts): from the leaves' level up, for each node the start of
    its children, and the mask and pattern of the bits that all codes below share."""
    levels, starts = [], runs
    low = high = codes
    for _ in range(2):
        ends = np.append(starts[1:], len(low))
        count = -(-(ends - starts) // FANOUT)
        first = np.repeat(starts, count) + FANOUT * (np.arange(count.sum()) - np.repeat(count.cumsum() - count, count))
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        levels.append((first, ~(low ^ high), low))
        starts = np.concatenate([[0], count.cumsum()[:-1]])
    levels.append((starts,))
    return levels


def _children(starts: np.ndarray, total: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``at``: how many children each has, and all of them one after another."""
    ends = np.append(starts[1:], total)
    count = ends[at] - starts[at]
    return count, np.repeat(starts[at], count) + np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)


def near_pairs(queries: np.ndarray, runs_of: np.ndarray, codes: np.ndarray, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, code) at DISTANCE bits or fewer; a query searches the run ``runs_of`` names."""
    (leaf, leaf_mask, leaf_bits), (upper, upper_mask, upper_bits), (top,) = _levels(codes, runs)
    weight = np.append(runs[1:], len(codes)) - runs
    chunks = (weight[runs_of].cumsum() >> 20) if len(queries) else np.zeros(0, np.int64)
    for chunk in np.unique(chunks):
        q = np.flatnonzero(chunks == chunk)
        count, node = _children(top, len(upper), runs_of[q])
        q = np.repeat(q, count)
        diff = _distance((queries[q] ^ upper_bits[node]) & upper_mask[node])
        keep = diff <= DISTANCE
        q, node, diff = q[keep], node[keep], diff[keep]
        count, child = _children(upper, len(leaf), node)
        q, parent, diff = np.repeat(q, count), np.repeat(node, count), np.repeat(diff, count)
        diff = diff + _distance((queries[q] ^ leaf_bits[child]) & leaf_mask[child] & ~upper_mask[parent])
        keep = diff <= DISTANCE
        q, node, diff = q[keep], child[keep], diff[keep]
        count, code = _children(leaf, len(codes), node)
        q, parent, diff = np.repeat(q, count), np.repeat(node, count), np.repeat(diff, count)
        diff = diff + _distance((queries[q] ^ codes[code]) & ~leaf_mask[parent])
        keep = diff <= DISTANCE
        yield q[keep], code[keep]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components among n nodes as links (a, b) have."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, old[a], low)
        np.minimum.at(root, old[b], low)
        root = root[root]
        if (root == old).all():
            node = np.flatnonzero(root != np.arange(n))
            return node, root[node]


def _first_equal_block(x: np.ndarray, turn: int) -> np.ndarray:
    """Whether no block before ``turn`` is equal in codes whose exclusive or is x."""
    ok = np.ones(len(x), bool)
    width = 64 // BLOCKS
    for t in range(turn):
        ok &= (x >> np.uint64(64 - width * (t + 1))) & np.uint64((1 << width) - 1) != 0
    return ok


def _links(codes_a: np.ndarray, codes_b: np.ndarray | None, turn: int, runs: np.ndarray | None = None, run_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links among codes_a (by runs), or between codes_a and codes_b; whole codes, by Gray rank."""
    inside = codes_b is None
    other = codes_a if inside else codes_b
    runs = np.zeros(1, np.int64) if runs is None else runs
    run_of = np.zeros(len(codes_a), np.int64) if run_of is None else run_of
    nodes = codes_a if inside else np.concatenate([codes_a, codes_b])
    shift = 0 if inside else len(codes_a)
    found_a, found_b = [], []
    for q, c in near_pairs(codes_a, run_of, other, runs):
        keep = _first_equal_block(codes_a[q] ^ other[c], turn)
        if inside:
            keep &= q < c
        a, b = q[keep], c[keep] + shift
        if len(a) > len(nodes):
            a, b = stars(len(nodes), a, b)
        found_a.append(a)
        found_b.append(b)
    node, root = stars(len(nodes), np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int),) * 2
    return nodes[node], nodes[root]


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of one range, sorted by turn and Gray rank: links of the runs inside it, and segments of the others."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    turns, codes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]).view(np.uint64)
    block = np.zeros(len(codes), np.int64)
    for t in range(BLOCKS):
        block[turns == t] = (turned(codes[turns == t], t) >> np.uint64(64 - 64 // BLOCKS)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (turns[1:] != turns[:-1]) | (block[1:] != block[:-1])]))
    size = np.diff(np.append(start, len(codes)))
    whole = size <= SEGMENT
    whole[[0, -1]] = False  # these may go on in the next range
    a, b = [], []
    for t in range(BLOCKS):
        mine = np.flatnonzero(whole & (turns[start] == t) & (size > 1))
        if len(mine):
            at = np.repeat(start[mine] - np.concatenate([[0], size[mine].cumsum()[:-1]]), size[mine]) + np.arange(size[mine].sum())
            runs = np.concatenate([[0], size[mine].cumsum()[:-1]])
            x, y = _links(codes[at], None, t, runs, np.repeat(np.arange(len(mine)), size[mine]))
            a.append(x)
            b.append(y)
    a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(a):
        none = [pa.nulls(len(a), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=[c.split()[0] for c in FOUND.split(", ")])
    base, n = TaskContext.get().partitionId() << 32, 0
    rows: list[tuple] = []
    for k in np.flatnonzero(~whole):
        for i in range(start[k], start[k] + size[k], SEGMENT):
            part = codes[i : min(i + SEGMENT, start[k] + size[k])]
            low, high = np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)
            rows.append((None, None, int(turns[i]), int(block[i]), base + n, _signed(int(~(low ^ high))), _signed(int(low)), part.view(np.int64)))
            n += 1
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 64]], kind) for j, kind in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair of segments; a segment paired with itself has no second codes."""
    for batch in batches:
        for turn, one, two in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            other = np.array(two.values, np.int64).view(np.uint64) if two.is_valid else None
            a, b = _links(np.array(one.values, np.int64).view(np.uint64), other, turn)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_links(codes: DataFrame) -> DataFrame:
    """(a, b): links that join the distinct codes as all links at DISTANCE or fewer bits do."""
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = codes.select("code", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("turn"))
    ranked = turns.withColumn("rank", _gray_rank(F.col("code"), F.col("turn")))
    ranges = ranked.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank").select("turn", "code")
    found = written(ranges.mapInArrow(_in_ranges, FOUND), "simhash-ranges")
    segments = found.where("segment is not null")
    one, two = (segments.select("turn", "block", *(F.col(c).alias(f"{c}{k}") for c in ("segment", "shared", "pattern"))) for k in (1, 2))
    may_meet = F.bit_count((F.col("pattern1").bitwiseXOR(F.col("pattern2"))).bitwiseAND(F.col("shared1")).bitwiseAND(F.col("shared2"))) <= DISTANCE
    pairs = one.join(two, ["turn", "block"]).where((F.col("segment1") < F.col("segment2")) & may_meet).select("turn", "segment1", "segment2")
    codes1, codes2 = (segments.select(F.col("segment").alias(f"segment{k}"), F.col("codes").alias(f"codes{k}")) for k in (1, 2))
    apart = pairs.join(codes1, "segment1").join(codes2, "segment2").select("turn", "codes1", "codes2")
    within = segments.select("turn", F.col("codes").alias("codes1"), F.lit(None).cast("array<long>").alias("codes2"))
    return found.where("a is not null").select("a", "b").unionByName(apart.unionByName(within).mapInArrow(_between, "a long, b long"))


def near_dedup(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, fingerprint, component_id and kept (one row of each component) of each document."""
    prints = fingerprints(docs, row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    codes = written(prints.groupBy("code").agg(F.min(order).alias("head")), "simhash-codes")
    roots = components(near_links(codes)).select(F.col("node").alias("code"), "root")
    rooted = codes.join(roots, "code", "left").select("code", "head", F.coalesce("root", "code").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("head").alias("first"))
    told = rooted.join(heads, "root").select("code", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row"))
    return prints.join(told, "code").select(
        "row", "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id", (F.col("row") == F.col("first_row")).alias("kept")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, all columns kept. Rows are told apart by numbers that are written once, as
    another scan of docs may number them anew."""
    docs, row = numbered(docs, "simhash-rows")
    dropped = written(near_dedup(docs, F.col(row)).where("not kept").select(F.col("row").alias(row)), "simhash-dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, row, "left_anti").drop(row)
