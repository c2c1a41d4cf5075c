"""Substring dedup by repeated-phrase automata.

A word is removed when a window of ``WINDOW`` consecutive words that covers it occurs anywhere else as well. Windows are
judged on the input.

* Anchors: of the grams (``GRAM`` words) inside a window the one with the smallest hash, leftmost if several have it, is the
  window's anchor. It follows from the window's words alone, so equal windows have equal anchors wherever they stand; neighbouring
  windows mostly share theirs, so a document has far fewer anchors than windows, each with a range of windows. A *segment* is the
  words of one anchor's windows. Only anchors whose hash occurs twice can lead to a repeated window.
* Confirming: the segments of recurring anchors, equal ones of a batch merged with their number (so a passage in a third of all
  documents is one row a batch), come together by anchor, and windows that recur are told by comparing their words. Runs of recurring windows are the repeated phrases.
* Automata: the phrases, written to the shared folder, are dealt to shards of a bounded number of words by anchor. A shard's
  phrases are compiled into an Aho-Corasick automaton over words (one character each).
* Locating: the segments of all documents are streamed through their shard's automaton, and only what it hits is removed. A shard
  with many segments is split by document, each part with the automaton of its own.
* Homes: where one anchor has more than ``DISTINCT`` distinct segments, its windows are dealt to several homes by their hash, and a
  segment goes to each home that one of its windows belongs to, at most ``WINDOW - GRAM + 1``. Hashes only say where words are
  compared, never whether they are equal.

The documents' words travel compressed, and only to find segments and to build the kept text; documents without a repeated
window are told from the first pass alone.

Defined cases: null text has no words; documents shorter than a window keep all; very long documents are read whole;
repeated rows repeat each other's windows; null doc_ids are kept as rows of their own; an empty table gives no rows; only doc_id
and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import written

WINDOW = 35
GRAM = 8
#: Distinct segments of one anchor in one home.
DISTINCT = 512
#: Words of phrases in one automaton (a few megabytes, as its nodes are read at random), and segments that one copy of it reads.
SHARD_WORDS = 32_000
STREAMED = 100_000
#: Words of documents whose anchors are found at once.
GROUP_WORDS = 100_000
#: Bytes of words that are hashed at once.
PIECE = 1 << 20

SCANNED = "row long, doc_id long, n_words long, sha256 string, words binary, anchors array<struct<h:long,first:int,last:int>>"
SEGMENT = "anchor long, row long, segment binary, firsts array<int>"
HOMED = "home long, row long, segment binary, firsts array<int>, n long"
SEEN = "home long, segment binary, n long"
PHRASE = "home long, phrase binary, words int"
RANGE = "row long, start int, stop int"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.cumprod(np.full(64, 0xA0761D6478BD642F, np.uint64), dtype=np.uint64)


def _batch(rows: list[tuple], shape: str, kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in shape.split(", ")])


def word_hashes(words: bytes) -> np.ndarray:
    """A hash of each of some words, joined by one blank; a piece of the bytes at a time."""
    found, at = [], 0
    while at < len(words):
        end = words.find(b" ", at + PIECE) if len(words) - at > PIECE else -1
        c = np.frombuffer(words[at:] if end < 0 else words[at:end], np.uint8)
        at = len(words) if end < 0 else end + 1
        blank = np.flatnonzero(c == 32)
        start = np.append(0, blank + 1)
        size = np.diff(np.append(start, len(c) + 1))  # with the blank behind
        place = np.arange(len(c)) - np.repeat(start, size)[: len(c)]
        value = (c.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
        value[blank] = 0
        h = np.add.reduceat(value, start) + size.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class _Letters(dict):
    """A character for each word, from the second on; the first stands for words that are not here."""

    def __missing__(self, word: bytes) -> str:
        k = len(self) + 2
        self[word] = letter = chr(k if k < 0xD800 else k + 0x800)  # not the surrogates
        return letter


class _Rolling:
    """Hashes of all runs of ``size`` words, from prefix sums modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray, size: int) -> np.ndarray:
        n = len(h)
        if len(self.up) < n + 1:
            self.up = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _BASE, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _BASE_INVERSE, np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(h * self.up[:n], dtype=np.uint64))
        x = (sums[size:] - sums[:-size]) * self.down[: n - size + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def anchors(h: np.ndarray, sizes: np.ndarray, rolling: _Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after another, h their words' hashes and sizes their lengths: the anchors' hashes, the first and last window of
    each, counted from its document's start, and how many anchors each document has."""
    if len(h) < WINDOW:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(len(sizes), np.int64))
    g = rolling(h, GRAM)
    width = WINDOW - GRAM + 1
    # the leftmost least of 2, 4, 8, ... grams from each place on, and then of a window's
    least, at, size = g, np.arange(len(g), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:] < least[:-step]
        least, at, size = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step]), size + step
    ends = sizes.cumsum()
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    whole = np.flatnonzero(np.arange(WINDOW, WINDOW + len(at)) <= ends[of])  # windows inside one document
    if not len(whole):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(len(sizes), np.int64))
    at = at[whole]
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    first, last = whole[new], whole[np.append(new[1:], len(at)) - 1]
    start = (ends - sizes)[of[first]]
    return g[at[new]], first - start, last - start, np.bincount(of[first], minlength=len(sizes))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling, press = _Rolling(), zstandard.ZstdCompressor(level=3)
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def ready(held: list[tuple]) -> pa.RecordBatch:
        h, first, last, count = anchors(word_hashes(b" ".join([x[5] for x in held if x[5]])), np.array([x[2] for x in held]), rolling)
        struct = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["h", "first", "last"])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array([x[i] for x in held], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.append(0, count.cumsum()), pa.int32()), struct)], names=names)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = (text or "").encode().split()
            joined = b" ".join(words)
            held.append((row, doc_id, len(words), hashlib.sha256(joined).hexdigest(), press.compress(joined), joined))
            size += len(words)
            if size > GROUP_WORDS:
                yield ready(held)
                held, size = [], 0
    if held:
        yield ready(held)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words, anchors of that row that recur): the words of each anchor's windows; equal ones of a document once, with all
    their places."""
    expand = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
    out: list[tuple] = []
    for batch in batches:
        lists = batch.column(2)
        flat = [x.to_pylist() for x in lists.flatten().flatten()]  # hashes, first and last windows
        bounds = lists.offsets.to_pylist()
        base = bounds[0]
        for k, (row, pressed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            mine = slice(bounds[k] - base, bounds[k + 1] - base)
            joined = expand.decompress(pressed)
            blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            begins, ends = np.append(0, blanks + 1).tolist(), np.append(blanks, len(joined)).tolist()
            found: dict[tuple[int, bytes], list[int]] = {}
            for h, first, last in zip(*(x[mine] for x in flat)):
                found.setdefault((h, joined[begins[first] : ends[last + WINDOW - 1]]), []).append(first)
            out += [(h, row, segment, firsts) for (h, segment), firsts in found.items()]
            if len(out) > 20_000:
                yield _batch(out, SEGMENT, kinds)
                out = []
    if out:
        yield _batch(out, SEGMENT, kinds)


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, homes, row, segment, firsts, n) of anchors with several homes: the segment in each home that a window of it belongs to."""
    rolling = _Rolling()
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64())
    for batch in batches:
        out: list[tuple] = []
        for anchor, homes, row, segment, firsts, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            out += [(home, row, segment, firsts, n) for home in set(_homes_of(word_hashes(segment), anchor, homes, rolling))]
        if out:
            yield _batch(out, HOMED, kinds)


def _homes_of(h: np.ndarray, anchor: int, homes: int, rolling: _Rolling) -> list[int]:
    """The home of each window of a segment."""
    return [(anchor + (int(x) % homes + 1) * _BASE & (1 << 64) - 1) - (1 << 63) for x in rolling(h, WINDOW)]


def confirmed(segments: dict[bytes, int]) -> dict[bytes, int]:
    """For one home's distinct segments and how often they occur: its phrases, runs of windows that recur, and their words."""
    letters = _Letters()
    split = [words.split() for words in segments]
    coded = ["".join(map(letters.__getitem__, words)) for words in split]
    counts: dict[str, int] = Counter()
    for c, n in zip(coded, segments.values()):
        for i in range(len(c) - WINDOW + 1):
            counts[c[i : i + WINDOW]] += n
    found: dict[bytes, int] = {}
    for c, words in zip(coded, split):
        start = None
        for i in range(len(c) - WINDOW + 2):
            recurs = i <= len(c) - WINDOW and counts[c[i : i + WINDOW]] > 1
            if recurs and start is None:
                start = i
            elif not recurs and start is not None:
                found[b" ".join(words[start : i + WINDOW - 1])] = i + WINDOW - 1 - start
                start = None
    return found


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal segments (home, segment, n) of a batch as one."""
    kinds = (pa.int64(), pa.binary(), pa.int64())
    for batch in batches:
        seen: dict[tuple[int, bytes], int] = Counter()
        for home, segment, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            seen[home, segment] += n
        yield _batch([(*k, n) for k, n in seen.items()], SEEN, kinds)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, segment, n) come sorted by home; a home's distinct segments are in memory."""
    kinds = (pa.int64(), pa.binary(), pa.int32())
    out: list[tuple] = []
    rows = itertools.chain.from_iterable(zip(*(batch.column(i).to_pylist() for i in range(3))) for batch in batches)
    for home, group in itertools.groupby(rows, key=lambda r: r[0]):
        held: dict[bytes, int] = {}
        for _, segment, n in group:
            held[segment] = held.get(segment, 0) + n
        if len(held) > 1:
            out += [(home, phrase, n) for phrase, n in confirmed(held).items()]
        else:  # nothing to compare: all of it recurs, or nothing
            out += [(home, segment, segment.count(b" ") + 1) for segment, n in held.items() if n > 1]
        if len(out) > 20_000:
            yield _batch(out, PHRASE, kinds)
            out = []
    if out:
        yield _batch(out, PHRASE, kinds)


class Phrases:
    """An Aho-Corasick automaton over words, for phrases as words joined by one blank."""

    def __init__(self, phrases: list[bytes]):
        self.letters = _Letters()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in phrases:
            coded = "".join(map(self.letters.__getitem__, phrase.split()))
            self.automaton.add_word(coded, len(coded))
        if phrases:
            self.automaton.make_automaton()

    def ranges(self, words: bytes) -> list[tuple[int, int]]:
        """Ranges of words that the phrases' occurrences cover."""
        found: list[tuple[int, int]] = []
        if not self.letters:
            return found
        for end, size in self.automaton.iter("".join([self.letters.get(w, "\1") for w in words.split()])):
            a, b = end + 1 - size, end + 1
            while found and found[-1][1] >= a:
                a = min(a, found.pop()[0])
            found.append((a, b))
        return found


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, firsts, row, words) come sorted: the phrases of a shard first, without places, then the segments that go through
    its automaton."""
    names = [c.split()[0] for c in RANGE.split(", ")]
    at, phrases, automaton = None, [], None
    for batch in batches:
        rows, starts, stops = [], [], []
        for shard, part, firsts, row, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if at != (shard, part):
                at, phrases, automaton = (shard, part), [], None
            if firsts is None:
                phrases.append(words)
                continue
            if automaton is None:
                automaton = Phrases(phrases)
                phrases = []
            for a, b in automaton.ranges(words):
                for first in firsts:
                    rows.append(row)
                    starts.append(first + a)
                    stops.append(first + b)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=names)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for doc_id, n, pressed, ranges in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = expand.decompress(pressed).split()
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, [r["start"] for r in ranges], 1)
            np.add.at(step, [r["stop"] for r in ranges], -1)
            keep = step.cumsum()[:n] == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
            out.append((doc_id, n, int(n - keep.sum()), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def scan(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(_scan, SCANNED), "substring-scan")


def _homed(segments: DataFrame, several: DataFrame) -> DataFrame:
    """(home, row, segment, firsts, n) of segments (anchor, row, segment, firsts, n): the home is the anchor, or of anchors in
    ``several`` there are one or more."""
    dealt = segments.join(several, "anchor", "left")
    one = dealt.where("homes is null").select(F.col("anchor").alias("home"), "row", "segment", "firsts", "n")
    some = dealt.where("homes is not null").select("anchor", "homes", "row", "segment", "firsts", "n")
    return one.unionByName(some.mapInArrow(_homes, HOMED))


def repeated_phrases(segments: DataFrame, most: int = DISTINCT) -> tuple[DataFrame, DataFrame]:
    """(home, phrase, words): the phrases confirmed in segments; and (anchor, homes) of anchors with several homes."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = segments.select("anchor", F.xxhash64("segment").alias("h")).distinct().groupBy("anchor").count()
    several = written(different.where(F.col("count") > most).select("anchor", F.ceil(F.col("count") / most).cast("long").alias("homes")), "substring-homes")
    places = segments.select("anchor", F.lit(None).cast("long").alias("row"), "segment", F.lit(None).cast("array<int>").alias("firsts"), F.size("firsts").cast("long").alias("n"))
    merged = _homed(places, several).select("home", "segment", "n").mapInArrow(_merged, SEEN)
    return written(merged.repartition(parts, "home").sortWithinPartitions("home").mapInArrow(_confirm, PHRASE), "substring-phrases"), several


def located(segments: DataFrame, phrases: DataFrame, several: DataFrame, shard_words: int = SHARD_WORDS, streamed: int = STREAMED) -> DataFrame:
    """(row, start, stop) of what the shards' automata hit in segments."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 + (phrases.agg(F.sum("words")).first()[0] or 0) // shard_words
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    counted = segments.select("anchor", "row", "segment", "firsts", F.lit(1).cast("long").alias("n"))
    stream = _homed(counted, several).select(shard, "firsts", "row", F.col("segment").alias("words"))
    sizes = written(stream.groupBy("shard").agg(F.ceil(F.count("*") / streamed).cast("long").alias("parts")), "substring-shards")
    read = stream.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("row"), "parts").alias("part"), "firsts", "row", "words")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    built = phrases.select(shard, F.col("phrase").alias("words")).join(sizes, "shard").select("shard", each, F.lit(None).cast("array<int>").alias("firsts"), F.lit(None).cast("long").alias("row"), "words")
    ordered = read.unionByName(built).repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", F.col("firsts").isNotNull())
    return ordered.mapInArrow(_locate, RANGE)


def repeated_ranges(scanned: DataFrame, most: int = DISTINCT, shard_words: int = SHARD_WORDS, streamed: int = STREAMED) -> DataFrame:
    """(row, start, stop): ranges of words that repeated windows cover."""
    found = scanned.select("row", F.explode("anchors").alias("x")).select("row", "x.h", "x.first", "x.last")
    recurring = written(found.groupBy("h").count().where("count > 1").select("h"), "substring-anchors")  # a table of its own, so that a hot anchor's join can be split
    by_row = found.join(recurring, "h").groupBy("row").agg(F.collect_list(F.struct("h", "first", "last")).alias("found"))
    segments = written(scanned.select("row", "words").join(by_row, "row").select("row", "words", "found").mapInArrow(_segments, SEGMENT), "substring-segments")
    phrases, several = repeated_phrases(segments, most)
    return located(segments, phrases, several, shard_words, streamed)


def remove_repeats(docs: DataFrame, most: int = DISTINCT, shard_words: int = SHARD_WORDS, streamed: int = STREAMED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    scanned = written(rows.mapInArrow(_scan, SCANNED), "substring-scan")
    ranges = repeated_ranges(scanned, most, shard_words, streamed)
    ranges = written(ranges.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "substring-ranges")
    touched = scanned.select("row", "doc_id", "n_words", "words").join(ranges, "row").select("doc_id", "n_words", "words", "ranges").mapInArrow(_remove, REMOVED)
    whole = scanned.select("row", "doc_id", "n_words", "sha256").join(ranges.select("row"), "row", "left_anti")
    return touched.unionByName(whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256")))
