"""Packing token sequences: minimum bin slack over the lengths that whole windows leave.

* ``pieces``: one pass encodes the documents (an end id closes each), cuts whole windows off and writes what is left of
  each document, its length, and its place among the equal lengths of its partition.
* ``plan``: only the lengths' counts (at most ``window - 1`` numbers) reach the driver. The largest remaining length
  opens a window; a bitset subset-sum over the remaining multiset (counts split in powers of two) finds the sums that can
  be reached, the closest to capacity is taken, and walking the bitsets back gives how many of each length it uses. The
  pattern is repeated while its lengths last. A length that no multiset completes is set aside; at the end those are
  laid out one after another and cut at the windows' ends, so that at most one window has padding.
* Places become sequences by arithmetic: a length's documents are ranked by partition and place, and each range of ranks
  belongs to one pattern, whose window and offset follow from the rank.

Defined cases: null text counts as empty, which leaves the end id alone; long texts give many whole windows; repeated
rows, and rows without a doc_id, are packed each by itself; an empty table gives no rows; only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import byte_symbols, splitter
from textloom.llm.scratch import written

WINDOW = 1024
END_ID = 0
#: Words, and characters of words, in a task's memory before it starts afresh.
CACHE, CACHE_CHARACTERS = 500_000, 16 << 20
PIECE = "part int, doc_id long, tokens long, crcs array<long>, first long, rest int, place int, rest_ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Ids(dict):
    """Ids of pre-split words, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.split = splitter(False)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_symbols()))

    def __missing__(self, word: str) -> bytes:
        """A word is split already: the library's model encodes it, spelt in the characters that stand for its bytes."""
        if word in self.added:
            ids = [self.tokenizer.token_to_id(word)]
        else:
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
        self.held += len(word)
        self[word] = got = b"".join([i.to_bytes(4, "little") for i in ids])
        return got

    def of(self, text: str) -> bytes:
        """The whole text's ids. Words are split as the library's byte-level pattern splits them, and encoded once each."""
        if len(self) > CACHE or self.held > CACHE_CHARACTERS:
            self.clear()
            self.held = 0
        if not any(x in text for x in self.added):
            return b"".join(map(self.__getitem__, self.split(text)))
        return b"".join(self[x] if k % 2 else b"".join(map(self.__getitem__, self.split(x))) for k, x in enumerate(self.marks.split(text)))


@cache
def _ids(path: str) -> _Ids:
    return _Ids(path)


def _narrow(ids: bytes) -> bytes:
    """Ids in two bytes each where all fit, else in four."""
    wide = np.frombuffer(ids, "<u4")
    return ids if len(wide) and wide.max() > 0xFFFF else wide.astype("<u2").tobytes()


def _wide(ids: bytes, n: int) -> np.ndarray:
    """The n ids that _narrow wrote."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Of each document: its number of tokens, CRCs of its whole windows, and the rest."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, places, windows = TaskContext.get().partitionId(), _ids(path), np.zeros(window, np.int64), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = known.of(text or "") + end
                whole = len(ids) // (4 * window)
                rest = ids[4 * window * whole :]
                left = len(rest) // 4
                crcs = [zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)]
                out.append((part, doc_id, len(ids) // 4, crcs, windows, left, int(places[left]), _narrow(rest)))
                places[left] += 1
                windows += whole
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE), "packing-pieces")


def best_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths (with how many there are of each), a multiset whose sum is closest to room without passing it."""
    reach, full, before = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # counts in powers of two: each sum of up to ``left`` lengths is reached
            step = min(step, left)
            reach |= (reach << (length * step)) & full
            left, step = left - step, step * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, reach in reversed(before):
        n = 0
        while not reach >> at & 1:
            at, n = at - length, n + 1
        if n:
            used[length] = n
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Ranges of ranks (length, first rank, first sequence, copies in a window, offset, position), and how many sequences.
    position is -1 in a pattern's range; else the range is laid out one after another from that position on."""
    left, aside = dict(counts), {}
    used = dict.fromkeys(counts, 0)
    ranges: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    while left:
        seed = max(left)
        left[seed] -= 1
        if not left[seed]:
            del left[seed]
        pattern = best_multiset(left, window - seed)
        left[seed] = left.get(seed, 0) + 1
        pattern[seed] = pattern.get(seed, 0) + 1
        if sum(length * n for length, n in pattern.items()) < window:  # nor will it be when fewer lengths are left
            aside[seed] = left.pop(seed)
            continue
        times = min(left[length] // n for length, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            ranges.append((length, used[length], sequences, n, offset, -1))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequences += times
    position = 0
    for length, n in aside.items():
        ranges.append((length, used[length], sequences, 1, 0, position))
        position += length * n
    return sorted(ranges), sequences + -(-position // window)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece of each document."""
    cut = pieces(docs, path, window)
    held = cut.where("rest > 0").groupBy("part", "rest").count()
    counts = {r.rest: r.n for r in held.groupBy("rest").agg(F.sum("count").alias("n")).collect()}
    ranges, sequences = plan(counts, window)
    starts = [(r[0], r[1]) for r in ranges]
    before = held.select("part", "rest", (F.sum("count").over(Window.partitionBy("rest").orderBy("part")) - F.col("count")).alias("before"))
    names = [c.split()[0] for c in PACKED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, doc_id, tokens, crcs, first, rest, rank, rest_ids in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                for i, crc in enumerate(crcs):
                    out.append((doc_id, i * window, window, crc, tokens, sequences + (part << 36) + first + i, 0))
                if not rest:
                    continue
                length, rank0, sequence, n, offset, position = ranges[bisect_right(starts, (rest, rank)) - 1]
                ids, begin = _wide(rest_ids, rest), len(crcs) * window
                if position < 0:
                    k = rank - rank0
                    spans = [(0, rest, sequence + k // n, offset + k % n * length)]
                else:
                    at = position + (rank - rank0) * length
                    split = min(rest, window - at % window)
                    spans = [(0, split, sequence + at // window, at % window)]
                    if split < rest:
                        spans.append((split, rest, sequence + at // window + 1, 0))
                for a, b, s, o in spans:
                    out.append((doc_id, begin + a, b - a, zlib.crc32(ids[a:b].tobytes()), tokens, s, o))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    # places within a length become ranks over all partitions
    ranked = cut.join(before, ["part", "rest"], "left").select(
        "part", "doc_id", "tokens", "crcs", "first", "rest", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("rank"), "rest_ids"
    )
    return ranked.mapInArrow(place, PACKED)
