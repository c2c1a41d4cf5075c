"""Importance resampling towards a target's distribution of word n-grams, with n-gram checksums from prefix CRCs.

Features of a text are its runs of 1 to ``most`` words, joined by one space; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``buckets``. A bucket's gain is the logarithm of how much more frequent it is in the target than in the documents; the sum of its
features' gains and a Gumbel draw from its id make a document's score, and the highest scores are drawn.

* Checksums: all texts of a batch are one array of bytes, in which A to Z are lower-case and every run of other separators is one space.
  It is read once, as a matrix whose rows advance together; the running CRC of each place follows from that of its row and of the rows
  before. A CRC without its initial and final inversions is linear over GF(2), so that of any n-gram is crc(to its end) xor
  crc(to its start) times x^(8 length) modulo the polynomial: two prefixes and one multiplication by table, whatever n is, and no n-gram
  is ever put together. Prefixes may begin in another document: what lies before an n-gram cancels out.
* Counts: every task adds its buckets' counts up and hands over one row a bucket; a plan of ``buckets`` rows, whatever the corpus.
* Ranks: scores are range-partitioned by (eligible, score, doc_id), rows are numbered within partitions as they are written, and a count
  per partition gives the offsets. No task sorts more than its range, and equal scores differ by doc_id.

Texts of any length are read whole, in batches of bytes that part between words (``PIECE``), each beginning again with the last most - 1
words, so that no n-gram is lost or counted twice.

Defined cases: null, empty and wordless texts have no features, weight 0, and are not drawn when ``least_words`` is above 0; a null doc_id
hashes as the empty text and comes behind other ids where scores are equal; repeated rows each count, each give a row and can each be drawn
(with one score and id, either order); an empty target or an empty table of documents gives gains from the remaining counts, an empty table
of documents no rows; only doc_id and text are read (text of the target), so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import written

MOST, BUCKETS = 1, 10_000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Bytes of text that a task reads at once.
PIECE = 1 << 20
POLYNOMIAL = 0xEDB88320
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


@cache
def byte_table() -> np.ndarray:
    """The CRC register after one byte, from zero."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


@cache
def shift_tables(digit: int) -> np.ndarray:
    """tables[d, k, b]: the register whose byte k is b, moved over d * 64**digit zero bytes; d from 0 to 63."""
    b = np.arange(256, dtype=np.uint32)
    tables = np.empty((64, 4, 256), np.uint32)
    tables[0] = b << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    if digit == 0:
        step = lambda x: byte_table()[x & 255] ^ (x >> 8)
    else:
        lower = shift_tables(digit - 1)
        one = lambda x, d: lower[d, 0][x & 255] ^ lower[d, 1][x >> 8 & 255] ^ lower[d, 2][x >> 16 & 255] ^ lower[d, 3][x >> 24]
        step = lambda x: one(one(x, 63), 1)
    for d in range(1, 64):
        tables[d] = step(tables[d - 1])
    return tables


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers times x^(8 by) modulo the polynomial."""
    by, digit = by.astype(np.int64), 0
    while by.any():
        t, d = shift_tables(digit), by & 63
        crc = t[d, 0, crc & 255] ^ t[d, 1, crc >> 8 & 255] ^ t[d, 2, crc >> 16 & 255] ^ t[d, 3, crc >> 24]
        by, digit = by >> 6, digit + 1
    return crc


class Prefixes:
    """Registers (from zero, uninverted) behind every prefix of some bytes: ``at(places)``."""

    def __init__(self, data: np.ndarray) -> None:
        self.width = 256
        rows = -(-len(data) // self.width)
        padded = np.zeros(rows * self.width, np.uint8)
        padded[: len(data)] = data
        matrix = np.ascontiguousarray(padded.reshape(rows, self.width).T)
        table, state = byte_table(), np.zeros(rows, np.uint32)
        self.inside = np.empty((self.width + 1, rows), np.uint32)
        self.inside[0] = 0
        for k in range(self.width):
            state = table[(state ^ matrix[k]) & 255] ^ (state >> 8)
            self.inside[k + 1] = state
        before, behind = np.zeros(rows, np.uint32), state.copy()
        # doubling: behind[r] covers rows r - 2**k + 1 to r
        span = 1
        while span < rows:
            behind[span:] ^= shifted(behind[:-span], np.full(rows - span, span * self.width))
            span *= 2
        before[1:] = behind[:-1]
        self.before = before

    def at(self, places: np.ndarray) -> np.ndarray:
        if not len(self.before):
            return np.zeros(len(places), np.uint32)
        row = np.minimum(places // self.width, len(self.before) - 1)
        column = places - row * self.width
        return self.inside[column, row] ^ shifted(self.before[row], column)


@cache
def _inverted() -> np.ndarray:
    """What the initial inversion adds behind n bytes, for n to 4095."""
    return shifted(np.full(4096, 0xFFFFFFFF, np.uint32), np.arange(4096))


def crc_between(prefixes: Prefixes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from start to end, each."""
    n = end - start
    first = _inverted()[np.minimum(n, 4095)]
    far = np.flatnonzero(n > 4095)
    if len(far):
        first[far] = shifted(np.full(len(far), 0xFFFFFFFF, np.uint32), n[far])
    return prefixes.at(end) ^ shifted(prefixes.at(start), n) ^ first ^ np.uint32(0xFFFFFFFF)


@cache
def _normal() -> np.ndarray:
    """Bytes of words as they are, A to Z lower-case, others 0."""
    t = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[low : high + 1] = np.arange(low, high + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def features(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts: words in each, and of all their n-grams the text's number and the CRC."""
    # a separator ends each text, so no word spans two
    raw = _normal()[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    word = raw != 0
    before = np.concatenate([[False], word[:-1]])
    kept = word | before  # words, and the first separator behind each
    data = np.where(word, raw, np.uint8(0x20))[kept]
    word = word[kept]
    ends = np.flatnonzero(~word)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    text_ends = np.cumsum([len(x) + 1 for x in texts])
    first = np.searchsorted(np.flatnonzero(kept)[ends], text_ends - 1, side="right")  # words up to each text's end
    words = np.diff(np.concatenate([[0], first]))
    prefixes = Prefixes(data)
    owner, crcs = [], []
    of = np.repeat(np.arange(len(texts)), words)
    for n in range(1, most + 1):
        size = len(of) - n + 1
        if size <= 0:
            break
        same = np.flatnonzero(of[:size] == of[n - 1 :])
        owner.append(of[same])
        crcs.append(crc_between(prefixes, starts[same], ends[same + n - 1]))
    none = np.zeros(0, np.int64)
    return words, np.concatenate(owner) if owner else none, np.concatenate(crcs) if crcs else none.astype(np.uint32)


def _pieces(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces between words, with how many words at the beginning of each were in the piece before."""
    at, carried, again = 0, b"", 0
    separators = _normal() == 0
    while len(text) - at > PIECE:
        end = at + PIECE
        tail = separators[np.frombuffer(text, np.uint8, end - at, at)]
        last = np.flatnonzero(tail)
        while not len(last) and end < len(text):  # a word longer than a piece stays whole
            step = min(PIECE, len(text) - end)
            last = np.flatnonzero(separators[np.frombuffer(text, np.uint8, step, end)]) + (end - at)
            end += step
        if not len(last):
            break
        cut = at + int(last[-1]) + 1
        piece = carried + text[at:cut]
        yield piece, again
        at = cut
        if most > 1:
            masked = _normal()[np.frombuffer(piece, np.uint8)] != 0
            begin = np.flatnonzero(masked & ~np.concatenate([[False], masked[:-1]]))[-(most - 1) :]
            again = len(begin)
            carried = piece[begin[0] :] if again else b""
    yield carried + text[at:], again


def counted(texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts after another: the text's numbers with their words, and of each n-gram the text's number and the CRC."""
    held: list[tuple[int, bytes, int]] = []
    size = 0

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, again = np.array([k for k, _, _ in held]), np.array([a for _, _, a in held])
        words, owner, crc = features([x for _, x, _ in held], most)
        if again.any():  # n-grams that lie within the words carried over were counted before
            at, keep = 0, np.ones(len(owner), bool)
            for n in range(1, most + 1):
                count = np.maximum(words - n + 1, 0)
                place = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
                keep[at : at + count.sum()] = place + n > np.repeat(again, count)
                at += count.sum()
            owner, crc = owner[keep], crc[keep]
        n_words = np.zeros(len(texts), np.int64)
        np.add.at(n_words, numbers, words - again)
        return n_words, numbers[owner] if len(owner) else owner, crc

    for k, text in enumerate(texts):
        for piece, again in _pieces((text or "").encode("utf-8", "surrogatepass"), most):
            held.append((k, piece, again))
            size += len(piece)
            if size > PIECE:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def bucket_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column text fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc in counted(batch.column(0).to_pylist(), most):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    found = np.zeros(buckets, np.int64)
    for r in rows:
        found[r.bucket] = r.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's smoothed shares in target and source."""
    s, t = int(source.sum()), int(target.sum())
    size = len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        for batch in batches:
            n = batch.num_rows
            words, many, weight = (np.zeros(n, np.int64) for _ in range(3))
            for some, owner, crc in counted(batch.column(1).to_pylist(), most):
                words += some
                many += np.bincount(owner, minlength=n)
                np.add.at(weight, owner, value[crc % np.uint32(len(value))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WEIGHED)


def resample(
    docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null where a document is not drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed(docs, gain, most).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") < least_words).alias("short"))
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(scored, "scores").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = written(ranged.withColumn("place", F.monotonically_increasing_id()), "scores-ranked")
    part = F.shiftright("place", 33)
    ends = {r.part: (r.n, r.long) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("short"), 1)).alias("long")).collect()}  # a row a partition
    before, offsets = 0, []
    for p in sorted(ends):
        offsets.append((p, before))
        before += ends[p][0]
    drawn = percent * sum(n for _, n in ends.values()) // 100
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranked.join(starts, part == F.col("part"), "left").select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (rank <= drawn), rank).alias("rank"))
