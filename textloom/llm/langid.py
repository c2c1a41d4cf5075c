"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its character n-grams (1 to 4 letters or word ends) and the word itself, hashed into ``buckets``
rows of an embedding table. A text is the average of its subwords' embeddings; a linear layer and a softmax give the
languages' probabilities. Table and layer are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled documents (``sample``, a parameter). A fifth of the sample is held back to fit the softmax's
temperature and the rejection threshold: the largest, up to ``ceiling``, that rejects at most ``loss`` of the held-back
documents which the model gets right.

As the model is linear in the average, a subword's share of the scores is one row of numbers: tasks hash all n-grams of
some texts at once and add their rows up. Very long texts are scored whole, in pieces that part between words, which changes no sum; only
a word of more than ``CHUNK`` letters counts as several words of that many.

The sample is bounded in rows (an ordered limit, whatever repeats in the table); its texts are learned whole.

Defined cases: text that is null, empty or without a letter gives ``und`` with score 0 and is rejected; null doc_ids
are never learned from and count as not held out; with no labelled row at all every text is ``und``; repeated rows each give a row;
an empty table gives no rows; columns of any name are passed on by ``keep_identified``, and only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Characters that a task scores at once.
CHUNK = 1 << 18
#: Labelled documents to learn from, at most; each is learned whole.
SAMPLE = 2000
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # buckets x languages: embedding table times linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text, with 0 for all that is no letter, and a 0 at each end."""
    c = np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(c, 0xFFFF)]
    far = np.flatnonzero(c > 0xFFFF)
    if len(far):
        letter[far] = [chr(x).isalpha() for x in c[far].tolist()]
    return np.where(letter, c, np.uint32(0))


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(buckets)).astype(np.int32)


def subwords(c: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to 4 letters or word ends, and then for whole words: places in c, and their buckets."""
    inside = c != 0
    h, apart = np.zeros(len(c), np.uint32), np.ones(len(c), bool)
    for n in range(1, 5):
        size = len(c) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        if n > 2:
            apart = apart[:size] & inside[n - 2 : n - 2 + size]  # no word end between its ends
        ok = apart[:size] & (inside[:size] | inside[n - 1 :]) if n != 3 else apart[:size]
        at = np.flatnonzero(ok)
        yield at, _mixed(h[at], buckets)
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(start):
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        of = np.repeat(start, end - start)
        place = np.flatnonzero(inside)
        powers = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)
        yield start, _mixed(np.add.reduceat(c[place] * powers[(place - of) & 63], np.append(0, (end - start).cumsum()[:-1])) ^ np.uint32(0xA5A5A5A5), buckets)


def learned_pieces(text: str, buckets: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A whole text in pieces of so many words: the buckets of each piece's subwords, and how often each occurs."""
    words = text.split()
    for s in range(0, len(words), piece):
        ids = [x for _, x in subwords(letters_of(" ".join(words[s : s + piece])), buckets)]
        if ids and len(ids[0]):
            yield np.unique(np.concatenate(ids), return_counts=True)


def train(rows: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 3, rate: float = 2.0, piece: int = 40, ceiling: float = 0.4, loss: float = 0.001, seed: int = 1) -> LanguageModel:
    """rows: (text, language). Texts are learned whole, in pieces of words, so that short texts are learned too."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k, (text, lang) in enumerate(rows):
        (held if k % 5 == 4 else examples).extend((ids.astype(np.int32), n.astype(np.float32), langs.index(lang)) for ids, n in learned_pieces(text, buckets, piece))
    table = rng.normal(0, 0.1, (buckets, dim))
    layer = np.zeros((dim, len(langs)))
    bias = np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // 16)):
            if not len(at):
                continue
            ids, back_to = np.unique(np.concatenate([examples[i][0] for i in at]), return_inverse=True)
            share = np.zeros((len(at), len(ids)))  # of each subword in each piece
            share[np.repeat(np.arange(len(at)), [len(examples[i][0]) for i in at]), back_to] = np.concatenate([examples[i][1] / examples[i][1].sum() for i in at])
            hidden = share @ table[ids]
            p = softmax(hidden @ layer + bias)
            p[np.arange(len(at)), [examples[i][2] for i in at]] -= 1
            p /= len(at)
            back = p @ layer.T
            layer -= step * hidden.T @ p
            bias -= step * p.sum(0)
            table[ids] -= step * share.T @ back
    model = LanguageModel(langs, table @ layer, bias)
    if held:
        raw = np.array([n @ model.weights[i] / n.sum() + bias for i, n, _ in held])
        true = np.array([y for _, _, y in held])
        fits = {t: -np.log(softmax(raw / t)[np.arange(len(true)), true] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(fits, key=fits.get))
        p = softmax(raw / model.temperature)
        right = p.max(1)[p.argmax(1) == true]
        if len(right):
            model.threshold = float(min(ceiling, np.quantile(right, loss)))
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def scorer(model: LanguageModel):
    """A function from a list of texts to a list of (language, probability, rejected)."""
    # a column more counts the subwords
    weights = np.hstack([model.weights, np.ones((len(model.weights), 1))]).astype(np.float32)

    def sums(texts: list[str]) -> np.ndarray:
        """Summed scores and counts of some texts at once: a line end parts them, so that no subword spans two."""
        c = letters_of("\n".join(texts))
        starts = np.cumsum([0] + [len(x.lower()) + 1 for x in texts[:-1]]) + 1
        total = np.zeros((len(texts), weights.shape[1]))
        for at, bucket in subwords(c, len(weights)):
            # a gram that begins with the line end before a text is the text's own
            cut = np.searchsorted(at, starts - 1)
            cut[0] = 0
            rows = weights[bucket]
            some = np.flatnonzero(np.diff(np.append(cut, len(at))))
            if len(some):
                total[some] += np.add.reduceat(rows, cut[some], dtype=np.float64)
        return total

    def score(texts: list[str | None]) -> list[tuple[str, float, bool]]:
        totals, held, size = [], [], 0
        for text in texts:
            for piece in cut_long((text or "").lower()):
                held.append((len(totals), piece))
                size += len(piece)
            totals.append(np.zeros(weights.shape[1]))
            if size > CHUNK:
                fold_in(totals, held)
                held, size = [], 0
        fold_in(totals, held)
        return [told(x) for x in totals]

    def fold_in(totals: list, held: list) -> None:
        if held:
            for (k, _), got in zip(held, sums([x for _, x in held])):
                totals[k] = totals[k] + got

    def told(total: np.ndarray) -> tuple[str, float, bool]:
        if total[-1] == 0 or not model.langs:
            return UNKNOWN, 0.0, True
        p = softmax((total[:-1] / total[-1] + model.bias) / model.temperature)
        k = int(p.argmax())
        return model.langs[k], float(p[k]), bool(p[k] < model.threshold)

    return score


def cut_long(text: str) -> Iterator[str]:
    """A text in pieces of at most CHUNK characters, each but the last ending behind a character that is no letter. A word of more than
    CHUNK letters is cut after every CHUNK of them."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def fold(doc_id="doc_id"):
    """crc32 of the doc_id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def place(*columns: str):
    """A row's place in a sample, from 0 to 2**30, by hash."""
    return F.pmod(F.xxhash64(*columns, F.lit("train")), F.lit(1 << 30)).alias("place")


def share_of(bound: int, total: int) -> int:
    """The places that about a tenth more than ``bound`` of ``total`` rows have; an ordered limit takes the rest away."""
    return int(min(1.0, 1.1 * bound / max(1, total)) * (1 << 30)) + 1


def training_rows(docs: DataFrame, label: str, bound: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows outside the held-out fold, spread evenly over the table by hash."""
    labelled = docs.where(F.col(label).isNotNull() & (fold() != 0)).select(place("doc_id", "text", label), F.coalesce("text", F.lit("")).alias("text"), F.col(label).alias("label"))
    few = labelled.where(F.col("place") < share_of(bound, labelled.count()))
    return few.orderBy("place", "text", "label").limit(bound).select("text", "label")


def fit(docs: DataFrame, bound: int = SAMPLE, **options) -> LanguageModel:
    rows = [tuple(x) for x in training_rows(docs, "lang", bound).collect()]
    return train(rows, **options) if rows else LanguageModel([], np.zeros((1, 0)), np.zeros(0))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # a table of a fixed size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            got = score(batch.column(2).to_pylist())
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(predict, PREDICTED)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """docs without the documents whose language is rejected, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not rejected for _, _, rejected in score(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
