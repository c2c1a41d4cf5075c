"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when their UTF-8 bytes agree after every character of [\\x20\\x09-\\x0D] is deleted.

* ``entries``: one pass over the documents. Each Arrow batch keeps one *body* for each distinct text in it, with the
  batch's count and best row; the other rows only point to their body (``rep``). So a text that a third of all rows share
  reaches the index once per batch, not once per row.
* ``directory``: the bodies' 64-bit hashes are counted by their leading bits. A bucket that holds more than
  ``capacity`` bodies is split by one more bit, doubling the directory where that is needed, until it fits or the last
  depth is reached. The directory is a table of slots and is written beside the entries.
* ``leads``: a bucket that stays overfull at the last depth holds a hash of very many bodies: one text that comes in most batches. Its
  bodies are dealt to as many parts as it overflows, each of which compares bytes and sends on one body for each distinct text (its lead)
  with their counts and best row, so no task reads a hot text more than about ``capacity`` times.
* ``chains``: owner tasks each take whole buckets, sorted by hash, and walk them with the chain of one hash in memory:
  bodies of one hash are compared byte by byte, so that colliding texts stay apart.

Defined cases: null text counts as empty; of equal texts the row with the most code points stays, then the smallest
doc_id (null last), then the first row read, so of repeated rows exactly one stays; empty tables give empty results; texts of any
length are one body each, hashed and compared whole; columns of any name ride along in ``drop_copies``, whose row numbers take a
name that no column has, and only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import numbered, written

BLANKS = b" \t\n\x0b\x0c\r"
#: Bodies in a bucket before it splits, and how many levels deeper than a full, even directory it may grow.
CAPACITY = 4096
EXTRA_DEPTH = 3
#: Directories up to this many slots are broadcast; larger ones are joined by shuffle.
BROADCAST_SLOTS = 1 << 16
#: Lists of up to this many row numbers (8 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 20

ENTRY = "uid long, doc_id long, text_sha256 string, rep long, h long, body binary, n long, best_chars long, best_id long, best_uid long"
LEAD = "bucket long, h long, body binary, rep long, n long, best_chars long, best_id long, best_uid long, lead long"
CHAIN = "rep long, bucket long, keep_id long, keep_uid long, group_size long"


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (chars, doc_id, uid) the one that stays."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bytes, list] = {}
        out: dict[str, list] = {c.split()[0]: [] for c in ENTRY.split(", ")}
        for uid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text or ""
            body = text.encode().translate(None, BLANKS)
            best = (len(text), doc_id, uid)
            new = body not in seen
            if new:
                seen[body] = [uid, hashlib.sha256(body).hexdigest(), xxhash.xxh64_intdigest(body) - (1 << 63), 0, best, len(out["uid"])]
            head = seen[body]
            head[3], head[4] = head[3] + 1, _better(head[4], best)
            for k, v in (("uid", uid), ("doc_id", doc_id), ("text_sha256", head[1]), ("rep", head[0]), ("h", head[2] if new else None), ("body", body if new else None)):
                out[k].append(v)
        for k in ("n", "best_chars", "best_id", "best_uid"):
            out[k] = [None] * len(out["uid"])
        for _, _, _, count, best, at in seen.values():
            out["n"][at], out["best_chars"][at], out["best_id"][at], out["best_uid"][at] = count, *best
        kinds = {"text_sha256": pa.string(), "body": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def build_entries(docs: DataFrame, uid: Column | None = None) -> DataFrame:
    """uid numbers the rows; it is computed once here, as the entries are written."""
    uid = F.monotonically_increasing_id() if uid is None else uid
    return written(docs.select(uid.alias("uid"), F.col("doc_id").cast("long"), "text").mapInArrow(_entries, ENTRY), "dedup-entries")


def build_directory(bodies: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """Slots of the directory (slot, depth, bucket, parts), its global depth, and the number of buckets' owners it asks for. parts is above 1
    for buckets that are overfull at the last depth."""
    total = bodies.count()
    even = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    depth = even + EXTRA_DEPTH
    slots = bodies.groupBy(_slot(F.col("h"), depth).alias("slot")).count()
    # the bucket of a slot is the shortest prefix, from the even depth on, that is not overfull
    chosen = F.lit(depth)
    for d in range(depth - 1, even - 1, -1):
        held = F.sum("count").over(Window.partitionBy(F.shiftright("slot", depth - d)))
        slots = slots.withColumn(f"n{d}", held)
        chosen = F.when(F.col(f"n{d}") <= capacity, F.lit(d)).otherwise(chosen)
    slots = slots.withColumn("depth", chosen)
    bucket = F.expr(f"(cast(depth as bigint) << 56) | (slot >> ({depth} - depth))")
    parts = F.when(F.col("depth") == depth, F.ceil(F.col("count") / capacity)).otherwise(1).cast("long")
    return written(slots.select("slot", "depth", bucket.alias("bucket"), parts.alias("parts")), "dedup-directory"), depth, max(1, 1 << even)


def _slot(h, depth: int):
    return F.shiftrightunsigned(h, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def _closed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (bucket, h, body, rep, n, chars, id, uid) come sorted by bucket and hash; the chain of one hash is in memory. Of each distinct body:
    (bucket, h, body, reps, n, best)."""
    at, chain = None, {}
    for bucket, h, body, rep, n, *best in rows:
        if (bucket, h) != at:
            yield from ((*at, k, *link) for k, link in chain.items())
            at, chain = (bucket, h), {}
        link = chain.get(body)  # compares the bytes of bodies whose hashes collide
        if link is None:
            chain[body] = [[rep], n, tuple(best)]
        else:
            link[0].append(rep)
            link[1] += n
            link[2] = _better(link[2], tuple(best))
    yield from ((*at, k, *link) for k, link in chain.items())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(8)))


def _batches(rows: Iterator[tuple], columns: str, size: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in columns.split(", ")]
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), kinds)], names=names)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each rep: its lead; the lead's own row has the body, the sum of counts and the best row."""

    def run() -> Iterator[tuple]:
        for bucket, h, body, reps, n, best in _closed(_rows(batches)):
            yield bucket, h, body, reps[0], n, *best, reps[0]
            yield from ((bucket, h, None, rep, None, None, None, None, reps[0]) for rep in reps[1:])

    yield from _batches(run(), LEAD, 1024)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each rep: its bucket, and its text's row that stays and number of rows."""

    def run() -> Iterator[tuple]:
        for bucket, _, _, reps, n, (_, keep_id, keep_uid) in _closed(_rows(batches)):
            yield from ((rep, bucket, keep_id, keep_uid, n) for rep in reps)

    yield from _batches(run(), CHAIN, 1 << 14)


def build_index(docs: DataFrame, capacity: int = CAPACITY, uid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries, one for each row of docs, and the chains, one for each body."""
    entries = build_entries(docs, uid)
    bodies = entries.where(F.col("body").isNotNull())
    directory, depth, owners = build_directory(bodies, capacity)
    if (1 << depth) <= BROADCAST_SLOTS:
        directory = F.broadcast(directory)
    crowded = directory.agg(F.max("parts")).first()[0] or 1
    if (1 << depth) <= BROADCAST_SLOTS:
        directory = F.broadcast(directory)
    columns = ["bucket", "h", "body", "rep", "n", "best_chars", "best_id", "best_uid"]
    dealt = bodies.withColumn("slot", _slot(F.col("h"), depth)).join(directory, "slot").select(*columns, "parts")
    tasks = max(owners, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = lambda df: df.select(*columns).repartition(tasks, "bucket").sortWithinPartitions("bucket", "h").mapInArrow(_chains, CHAIN)
    if crowded == 1:
        return entries, owned(dealt)
    hot = dealt.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).repartition(tasks, "bucket", "part")
    leads = written(hot.sortWithinPartitions("part", "bucket", "h").select(*columns).mapInArrow(_leads, LEAD), "dedup-leads")
    chains = written(owned(dealt.where("parts = 1").unionByName(leads.where("rep = lead").select(*columns, F.lit(1).cast("long").alias("parts")))), "dedup-chains")
    followers = leads.where("rep <> lead").select(F.col("rep").alias("follower"), "lead").join(chains, F.col("lead") == F.col("rep"))
    return entries, chains.unionByName(followers.select(F.col("follower").alias("rep"), "bucket", "keep_id", "keep_uid", "group_size"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, uid: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and uid for each row of docs, dropped ones too."""
    entries, chains = build_index(docs, capacity, uid)
    return entries.select("uid", "doc_id", "text_sha256", "rep").join(chains, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "uid"
    )


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without its dropped copies, all columns kept. Whole rows may repeat, so rows are told apart by numbers; they are
    written once, as another scan of docs may number them anew."""
    docs, row = numbered(docs, "dedup-rows")
    dropped = written(exact_dedup(docs, capacity, F.col(row)).where("not kept").select(F.col("uid").alias(row)), "dedup-dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, row, "left_anti").drop(row)
