"""BPE encoding by a tokenization automaton, and decoding from its arc labels.

The automaton reads tokens. Its states are "nothing read" and, for each token, "this token read last"; a path from the
first state spells one segmentation of a word, and the arcs are chosen so that exactly the segmentation that the merges
produce has a path. It is built by one gadget a merge, in the order of the merges. The gadget of merge (u, v) -> w

* takes away the arc with label v from every state that ends in an exposed u: those two would have been merged;
* adds state w, a copy of state v as it is at that moment: what may follow v may follow w;
* adds, beside every arc labelled u whose target had the arc v, an arc labelled w.

The table of arcs is compiled as differences of rows. Every label has a place in an order in which the labels that were made to
stand beside one another's arcs lie together, latest first; the arcs that a gadget takes away are then one range of labels, and a state's
row is the ranges taken away from it, each with its gadget's number, besides those that the row it was copied from had lost by then.

Encoding is table-driven. Read by bytes, several tokens may be under way at a time; the sets of (token read last, label under way) that
can be reached are numbered as states of a deterministic automaton over bytes, and its transition table is filled in as words ask for
it. A state also tells which token, if any, ends with the byte just read: at most one has an arc from the state before it, so walking
back from a word's end gives its tokens.

Pre-splitting follows the tokenizer file: added tokens first, then NFC, lower case and white space where the file asks
for them, then its pattern. Words recur, so each task keeps the ids and labels of the words it has seen.

Defined cases: null text counts as empty and gives no ids and an empty decoded text; added tokens' strings in a text
are those tokens, as the library has it; texts of any length are read whole; repeated rows each give a row; an empty table gives no
rows; null doc_ids stay null; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Words, and characters of words, in a task's memory before it starts afresh; and states of the automaton over bytes.
CACHE, CACHE_CHARACTERS = 300_000, 8 << 20
STATES = 300_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# White space, letters and numbers of Latin-1, by Unicode's properties.
BLANK = "\\t-\\r \\x85\\xa0"
LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBER = "0-9²³¹¼½¾"
ANY_BLANK = BLANK + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return [shown[b] for b in range(256)]


def splitter(word_ends: bool):
    """A function from a text to its pre-split words: by the pattern with leading blanks, or the one that drops blanks."""

    def pattern(blank: str, letter: str, number: str) -> str:
        suffixes = "'s|'t|'re|'ve|'m|'ll|'d"
        other = f"[^{blank}{letter}{number}]"
        if word_ends:
            return f"{suffixes}|[{letter}]+|[{number}]|{other}+"
        return f"{suffixes}| ?[{letter}]+| ?[{number}]+| ?{other}+|[{blank}]+(?![^{blank}])|[{blank}]+"

    latin = re.compile(pattern(BLANK, LATIN_LETTER, LATIN_NUMBER)).findall
    wide = regex.compile(pattern(ANY_BLANK, r"\p{L}", r"\p{N}")).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return latin(text)

    return split


def lowered(text: str) -> str:
    """Each character's lower case by itself, so that a last sigma is like any other."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Automaton:
    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.word_ends = model.get("end_of_word_suffix") == END
        self.labels = {i: t for t, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.added.items()}
        self.joined_by = " " if spec.get("decoder") is None else ""
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.composed = '"NFC"' in json.dumps(spec.get("normalizer"))
        self.split = splitter(self.word_ends)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = 1 + max(self.labels)
        # a base token is read as one symbol: its byte, plus 256 at the end of a word
        shown = byte_symbols()
        self.spelt: dict[int, tuple[int, ...]] = {}
        for b, c in enumerate(shown):
            self.spelt[vocab[c]] = (b,)
            if self.word_ends:
                self.spelt[vocab[c + END]] = (b + 256,)
        # the gadgets; ends and begins: the token copied, and when the copy was made; cut: the arcs taken away
        self.ends: dict[int, tuple[int, int]] = {}
        self.begins: dict[int, tuple[int, int]] = {}
        self.cut: list[tuple[int, int]] = []
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.gadget(k, vocab[left], vocab[right], vocab[left + right])
        self.compile_rows()
        self.arcs: dict[int, bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, symbols in self.spelt.items():
            at = 0
            for s in symbols:
                if s not in self.trie[at]:
                    self.trie[at][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                at = self.trie[at][s]
            self.token[at] = token
        self.clear()

    def gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.cut.append((u, v))
        self.ends[w], self.begins[w] = (v, k), (u, k)
        self.spelt[w] = self.spelt[u] + self.spelt[v]

    def compile_rows(self) -> None:
        """rows: of each state the ranges of labels' places taken away: where they begin and end, by which gadget, and the range around."""
        made: dict[int, list[int]] = {}
        for w, (u, _) in self.begins.items():  # in the order of the gadgets
            made.setdefault(u, []).append(w)
        self.place: dict[int, int] = {}
        after: dict[int, int] = {}
        stack = [(t, False) for t in self.spelt if t not in self.begins]
        while stack:
            t, done = stack.pop()
            if done:
                after[t] = len(self.place)
                continue
            self.place[t] = len(self.place)
            stack.append((t, True))
            stack += [(w, False) for w in made.get(t, ())]  # the latest is taken first
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        for k, (u, v) in enumerate(self.cut):
            beside = made.get(v, ())
            first = bisect_left(beside, k, key=lambda w: self.begins[w][1])  # from here on they were made by gadget k or later
            ranges.setdefault(u, []).append((self.place[v], -(after[beside[first]] if first < len(beside) else self.place[v] + 1), k))
        self.rows: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
        for u, found in ranges.items():
            found.sort()
            around: list[int] = []
            open_: list[int] = []
            for i, (low, high, _) in enumerate(found):
                while open_ and -found[open_[-1]][1] <= low:
                    open_.pop()
                around.append(open_[-1] if open_ else -1)
                open_.append(i)
            self.rows[u] = [x[0] for x in found], [-x[1] for x in found], [x[2] for x in found], around

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after ``state`` has an arc labelled ``token``, by its row and those that it was copied from."""
        place, u, until = self.place[token], state, len(self.cut)
        while True:
            if u in self.rows:
                low, high, by, around = self.rows[u]
                i = bisect_right(low, place) - 1
                while i >= 0:
                    if place < high[i] and by[i] < until:
                        return False
                    i = around[i]
            if u not in self.ends:
                return True
            u, until = self.ends[u]

    def clear(self) -> None:
        """Only the first state: nothing read, all labels under way from here."""
        first = ((0, -1, 0),)
        self.known = {first: 0}
        self.sets = [first]
        self.ended = [-1]
        self.table: list[dict[int, int]] = [{}]

    def step(self, state: int, symbol: int) -> int:
        """Fills in a transition: the labels under way go on, and one of them may end here. Sets hold (symbols read since the label began, token
        read before it, node of the labels' trie)."""
        found, ended = [], -1
        for back, last, node in self.sets[state]:
            node = self.trie[node].get(symbol)
            if node is None:
                continue
            found.append((back + 1, last, node))
            token = self.token[node]
            if token >= 0 and ended < 0:
                if last >= 0:
                    key = last * self.size + token
                    arc = self.arcs.get(key)
                    if arc is None:
                        if len(self.arcs) > 4 * CACHE:
                            self.arcs.clear()
                        arc = self.arcs[key] = self.has_arc(last, token)
                    if not arc:
                        continue
                ended = token
        if ended >= 0:
            found.append((0, ended, 0))
        reached = tuple(found)
        to = self.known.get(reached)
        if to is None:
            to = self.known[reached] = len(self.sets)
            self.sets.append(reached)
            self.ended.append(ended)
            self.table.append({})
        self.table[state][symbol] = to
        return to

    def tokens(self, word: str) -> list[int]:
        symbols = list(word.encode())
        if self.word_ends:
            symbols[-1] += 256
        if len(self.sets) > STATES:
            self.clear()
        state, ended, table = 0, [], self.table
        for s in symbols:
            to = table[state].get(s)
            state = self.step(state, s) if to is None else to
            ended.append(self.ended[state])
        found, n = [], len(symbols)
        while n:
            found.append(ended[n - 1])
            n -= len(self.spelt[ended[n - 1]])
        return found[::-1]

    def words(self, text: str) -> list[str]:
        """Pre-split words, and added tokens as they are."""
        if self.marks is None or not any(x in text for x in self.added):
            return self.split(self.normal(text))
        found = []
        for k, piece in enumerate(self.marks.split(text)):
            found += [piece] if k % 2 else self.split(self.normal(piece))
        return found

    def normal(self, text: str) -> str:
        if self.composed and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return lowered(text) if self.lower else text

    def encode(self, text: str) -> list[int]:
        return [t for w in self.words(text) for t in ([self.added[w]] if w in self.added else self.tokens(w))]

    def decode(self, ids: list[int]) -> str:
        if self.joined_by:
            return self.joined_by.join(self.labels[i] for i in ids)
        value = {c: b for b, c in enumerate(byte_symbols())}
        return b"".join(self.labels[i].encode() if self.labels[i] in self.added else bytes(value[c] for c in self.labels[i]) for i in ids).decode(errors="replace")


@cache
def automaton(path: str) -> Automaton:
    """Compiled once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f))


class _Words(dict):
    """Of each word: its ids as little-endian unsigned 32-bit integers, and its decoded text."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine, self.held = machine, 0

    def tidy(self) -> None:
        if len(self) > CACHE or self.held > CACHE_CHARACTERS:
            self.clear()
            self.held = 0

    def __missing__(self, word: str) -> tuple[bytes, str]:
        m = self.machine
        self.held += len(word)
        ids = [m.added[word]] if word in m.added else m.tokens(word)
        self[word] = got = (b"".join(i.to_bytes(4, "little") for i in ids), m.decode(ids))
        return got


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document, for further work on tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            ids = [machine.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them. ``path`` names a tokenizer file that every node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        known = _Words(machine)
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for text in batch.column(1).to_pylist():
                known.tidy()
                got = [known[w] for w in machine.words(text or "")]
                ids = b"".join([g[0] for g in got])
                shown = machine.joined_by.join([g[1] for g in got])
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)
