"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words are its runs of letters, lower-cased. A word enters as a hashed word embedding and, beside it, the sum of
the hashed embeddings of its character n-grams (3 and 5 letters or word ends), so that inflected or unseen forms of a
stem are read by their characters. Windows of ``SPAN`` words, each overlapping the next by half, run through a gated recurrent
network in both directions; attention pools the states into one vector and a linear layer gives the window's score. A
text scores as its highest window, turned into a probability by Platt scaling on held-back training documents.

Training sees labels of documents only. Which windows of a toxic document are toxic starts from how much more frequent
their grams are in toxic documents, and is chosen anew by the network after each epoch. The number of documents to learn from
is bounded (``positives``, ``negatives``, by ordered limits, taken evenly over the table by hash); their texts are learned whole. Scoring reads every window of every whole text: a text of more than
``langid.CHUNK`` characters goes in pieces of whole strides of words, each beginning with the last stride of the one before, so that its
windows are those of the uncut text (a word of more than that many letters counts as several).

Defined cases: null, empty and wordless texts have the lowest score; null doc_ids are never learned from and count as not
held out; without labels of both kinds every text scores 0; repeated rows each give a row; an empty table gives no rows; only doc_id and
text (and toxic of labels) are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import langid
from textloom.llm.langid import cut_long, fold, letters_of, place, share_of

SPAN, STRIDE = 16, 8
GRAMS = (3, 5)
WORD_BUCKETS, GRAM_BUCKETS = 1 << 17, 1 << 22
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 4, 4, 8, 8
GRAM_SCALE = 0.3
#: Documents to learn from, at most; each is learned whole.
POSITIVES, NEGATIVES = 1500, 2500
#: Characters that a task scores at once.
CHUNK = 1 << 16
SCORED = "doc_id long, held_out boolean, score double, predicted int"
LOWEST = -12.0


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int32)


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of all words of the texts, in order: the text's number and the word's bucket; and for each gram size the grams'
    words and buckets."""
    c = letters_of("\n".join(texts))
    starts = np.cumsum([1] + [len(x.lower()) + 1 for x in texts[:-1]])
    inside = c != 0
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), [(np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in GRAMS]
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    text = np.searchsorted(starts, begin, "right") - 1
    place = np.flatnonzero(inside)
    powers = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)
    of = np.repeat(begin, end - begin)
    word = _mixed(np.add.reduceat(c[place] * powers[(place - of) & 63], np.append(0, (end - begin).cumsum()[:-1])), WORD_BUCKETS)
    number = np.cumsum(np.append(False, inside[1:] & ~inside[:-1])) - 1  # of the last word begun at each place
    grams = []
    for n in GRAMS:
        size = len(c) - n + 1
        if size <= 0:
            grams.append((np.zeros(0, np.int64), np.zeros(0, np.int32)))
            continue
        ok = np.ones(size, bool)
        for k in range(1, n - 1):
            ok &= inside[k : k + size]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x9E3779B1) + c[at + k]
        grams.append((number[at + 1], _mixed(h, GRAM_BUCKETS)))
    return text, word, grams


def windows_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over words grouped by text: word places (-1 past a text's end), and each window's text."""
    if not len(text):
        return np.zeros((0, SPAN), np.int64), np.zeros((0, SPAN), bool), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(first, len(text)))
    count = np.maximum(1, -(-(size - (SPAN - STRIDE)) // STRIDE))
    of = np.repeat(np.arange(len(first)), count)
    start = first[of] + STRIDE * (np.arange(count.sum()) - np.repeat(count.cumsum() - count, count))
    at = start[:, None] + np.arange(SPAN)
    mask = at < (first + size)[of][:, None]
    return np.where(mask, at, 0), mask, text[first][of]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters; ``forward`` gives the windows' scores and what ``backward`` needs for the gradients."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f, dim = np.float32, WORD_DIM + GRAM_DIM
        self.words = np.zeros((WORD_BUCKETS, WORD_DIM), f)  # from zero, so that what was never seen says nothing
        self.grams = np.zeros((GRAM_BUCKETS, GRAM_DIM), f)
        self.dense = {}
        for d in "fb":
            self.dense[f"W{d}"] = (rng.normal(0, 0.4, (dim, 3 * HIDDEN))).astype(f)
            self.dense[f"U{d}"] = (rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))).astype(f)
            self.dense[f"b{d}"] = np.zeros(3 * HIDDEN, f)
        self.dense |= {"Wa": rng.normal(0, 0.4, (2 * HIDDEN, ATTENTION)).astype(f), "ba": np.zeros(ATTENTION, f), "va": rng.normal(0, 0.4, ATTENTION).astype(f), "wo": rng.normal(0, 0.4, 2 * HIDDEN).astype(f), "bo": np.zeros(1, f)}
        self.scale, self.shift = 1.0, 0.0

    def __getstate__(self) -> dict:
        """Only the rows that training has touched travel to the tasks."""
        state = dict(self.__dict__)
        for name in ("words", "grams"):
            rows = np.flatnonzero(state[name].any(1))
            state[name] = (state[name].shape, rows.astype(np.int32), state[name][rows])
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = dict(state)
        for name in ("words", "grams"):
            shape, rows, values = state[name]
            table = np.zeros(shape, np.float32)
            table[rows] = values
            setattr(self, name, table)

    def inputs(self, word: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(word), WORD_DIM + GRAM_DIM), np.float32)
        x[:, :WORD_DIM] = self.words[word]
        for of, bucket in grams:
            if len(of):
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                x[of[first], WORD_DIM:] += GRAM_SCALE * np.add.reduceat(self.grams[bucket], first)
        return x

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        p, n = self.dense, len(at)
        states = np.empty((SPAN, n, 2 * HIDDEN), np.float32)
        steps: dict[str, list] = {"f": [], "b": []}
        for k, d in enumerate("fb"):
            a = x @ p[f"W{d}"] + p[f"b{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(SPAN) if d == "f" else reversed(range(SPAN)):
                g, u = a[at[:, t]], h @ p[f"U{d}"]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = mask[:, t, None]
                if keep:
                    steps[d].append((t, h, z, r, c, u[:, 2 * HIDDEN :], m))
                h = np.where(m, c + z * (h - c), h)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        u = np.tanh(states @ p["Wa"] + p["ba"])
        e = np.where(mask.T, u @ p["va"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, (x, at, states, steps, u, w, pooled)) if keep else logit

    def backward(self, held: tuple, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p = self.dense
        x, at, states, steps, u, w, pooled = held
        grad = {"wo": pooled.T @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["wo"]
        dw = (states * dpooled).sum(2)
        de = w * (dw - (w * dw).sum(0))
        du = de[:, :, None] * p["va"] * (1 - u * u)
        grad["va"] = np.einsum("tn,tna->a", de, u)
        grad["Wa"] = np.einsum("tnh,tna->ha", states, du)
        grad["ba"] = du.sum((0, 1))
        dstates = w[:, :, None] * dpooled + du @ p["Wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            W, U = p[f"W{d}"], p[f"U{d}"]
            dW, dU, db = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * HIDDEN, np.float32)
            dh = np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, c, un, m in reversed(steps[d]):
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = dh * m
                dc = on * (1 - z) * (1 - c * c)
                da = np.concatenate([on * (h - c) * z * (1 - z), dc * un * r * (1 - r), dc], 1)
                dr = np.concatenate([da[:, : 2 * HIDDEN], dc * r], 1)
                xt = x[at[:, t]]
                dW += xt.T @ da
                dU += h.T @ dr
                db += da.sum(0)
                np.add.at(dx, at[:, t], da @ W.T)
                dh = np.where(m, on * z + dr @ U.T, dh)
            grad |= {f"W{d}": dW, f"U{d}": dU, f"b{d}": db}
        return grad, dx


class _Trainer:
    """Adam for the layers, Adagrad for the rows of the embedding tables that a step touches."""

    def __init__(self, net: Network, rate: float = 0.01, row_rate: float = 0.1):
        self.net, self.rate, self.row_rate, self.t = net, rate, row_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.seen = {"words": np.full(WORD_BUCKETS, 1e-6, np.float32), "grams": np.full(GRAM_BUCKETS, 1e-6, np.float32)}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.net.dense[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def rows(self, table: str, bucket: np.ndarray, g: np.ndarray) -> None:
        which, back = np.unique(bucket, return_inverse=True)
        total = np.zeros((len(which), g.shape[1]), np.float32)
        np.add.at(total, back, g)
        self.seen[table][which] += (total * total).mean(1)
        getattr(self.net, table)[which] -= self.row_rate * total / np.sqrt(self.seen[table][which])[:, None]


class _Corpus:
    """Training texts as words, grams by word, and windows; 4-byte numbers, as all of it is in one process."""

    def __init__(self, texts: list[str]):
        text, word, gram, size = [], [], [], []
        for i in range(0, len(texts), 64):
            t, w, grams = words_in(texts[i : i + 64])
            of, bucket = (np.concatenate([g[k] for g in grams]) for k in (0, 1))
            text.append((t + i).astype(np.int32))
            word.append(w)
            gram.append(bucket[np.argsort(of, kind="stable")])
            size.append(np.bincount(of, minlength=len(w)))
        self.text, self.word, self.gram = (np.concatenate(x) for x in (text, word, gram))
        self.gram_start = np.append(0, np.concatenate(size).cumsum())
        at, self.mask, of = windows_of(self.text)
        self.at, self.of = at.astype(np.int32), of.astype(np.int32)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of some words: places in ``words``, and buckets."""
        size = self.gram_start[words + 1] - self.gram_start[words]
        at = np.repeat(self.gram_start[words] - (size.cumsum() - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(words)), size), self.gram[at]

    def batch(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, at = np.unique(self.at[windows], return_inverse=True)
        return words, at.reshape(len(windows), SPAN), self.mask[windows]

    def scores(self, net: Network) -> np.ndarray:
        out = np.zeros(len(self.at), np.float32)
        for i in range(0, len(out), 4096):
            words, at, mask = self.batch(np.arange(i, min(i + 4096, len(out))))
            out[i : i + 4096] = net.forward(net.inputs(self.word[words], [self.grams_of(words)]), at, mask)
        return out


def _seed_scores(corpus: _Corpus, label: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Of each window: the highest z-score, over its words' grams, of the gram's share of toxic against other documents."""
    count = np.zeros((2, GRAM_BUCKETS), np.int32)
    words = np.flatnonzero(np.append(True, corpus.text[1:] != corpus.text[:-1]))
    for first, last in zip(words, np.append(words[1:], len(corpus.text))):
        text = corpus.text[first]
        if used[text]:
            count[1 - label[text], np.unique(corpus.gram[corpus.gram_start[first] : corpus.gram_start[last]])] += 1
    size = [max(1, (label[used] == v).sum()) for v in (1, 0)]
    both = (count[0] + count[1]) / (size[0] + size[1])
    z = (count[0] / size[0] - count[1] / size[1]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / size[0] + 1 / size[1]))
    z, word = z.astype(np.float32), np.zeros(len(corpus.word), np.float32)
    for i in range(0, len(word), 1 << 16):  # every word has a gram
        start = corpus.gram_start[i : min(i + (1 << 16), len(word))]
        end = corpus.gram_start[min(i + (1 << 16), len(word))]
        word[i : i + (1 << 16)] = np.maximum.reduceat(z[corpus.gram[start[0] : end]], start - start[0])
    return np.where(corpus.mask, word[corpus.at], -np.inf).max(1)


def train(rows: list[tuple[str, int]], epochs: int = 7, per_text: int = 4, batch: int = 256, base_rate: float | None = None, seed: int = 1) -> Network | None:
    """rows: (text, 0 or 1), with base_rate the share of toxic texts where they come from. None without texts of both kinds."""
    rows = [(x, y) for x, y in rows if any(map(str.isalpha, x))]
    label = np.array([y for _, y in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    corpus, net = _Corpus([x for x, _ in rows]), Network(seed)
    trainer = _Trainer(net)
    held = np.zeros(len(rows), bool)
    for v in (0, 1):  # a sixth of either kind is held back
        held[np.flatnonzero(label == v)[5::6]] = True
    score = _seed_scores(corpus, label, ~held)
    size = np.bincount(corpus.of, minlength=len(rows))
    for epoch in range(epochs):
        if epoch in (3, 5):
            score = corpus.scores(net)
        order = np.lexsort((-score, corpus.of))
        rank = np.arange(len(order)) - np.repeat(size.cumsum() - size, size)
        likely = (rank == 0) | ((rank < 6) & (score[order] > (5.0 if epoch < 3 else 1.0)))
        positive = order[likely & (label[corpus.of[order]] == 1) & ~held[corpus.of[order]]]
        hard = order[(rank < 2) & (label[corpus.of[order]] == 0) & ~held[corpus.of[order]]]
        other = np.flatnonzero((label[corpus.of] == 0) & ~held[corpus.of] & (rng.random(len(corpus.of)) < per_text / size[corpus.of]))
        negative = np.concatenate([hard, other])
        copies = max(1, len(negative) // (3 * max(1, len(positive))))
        chosen = np.concatenate([np.tile(positive, copies), negative])
        truth = np.concatenate([np.ones(len(positive) * copies), np.zeros(len(negative))]).astype(np.float32)
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(chosen), batch):
            pick = shuffled[i : i + batch]
            words, at, mask = corpus.batch(chosen[pick])
            # some windows without a toxic word are cut short, as short texts are windows too
            length = np.where((truth[pick] == 0) & (rng.random(len(pick)) < 0.4), rng.integers(1, SPAN, len(pick)), SPAN)
            mask = mask & (np.arange(SPAN) < length[:, None])
            # and in some one word is repeated, as in junk
            junk = (truth[pick] == 0) & (rng.random(len(pick)) < 0.1)
            at[junk] = at[junk, :1]
            of, bucket = corpus.grams_of(words)
            x = net.inputs(corpus.word[words], [(of, bucket)])
            logit, kept = net.forward(x, at, mask, keep=True)
            grad, dx = net.backward(kept, (_sigmoid(logit) - truth[pick]) / len(pick))
            trainer.step(grad)
            trainer.rows("words", corpus.word[words], dx[:, :WORD_DIM])
            if len(of):
                trainer.rows("grams", bucket, GRAM_SCALE * dx[of, WORD_DIM:])
    best = np.full(len(rows), LOWEST)
    np.maximum.at(best, corpus.of, corpus.scores(net).astype(np.float64))
    net.scale, net.shift = platt(best[held], label[held], label.mean() if base_rate is None else base_rate) if len(set(label[held].tolist())) == 2 else (1.0, 0.0)
    return net


def platt(x: np.ndarray, y: np.ndarray, base_rate: float, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * x + shift) fit y, with Platt's softened targets and the kinds weighted as they
    are found, by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, base_rate / n1, (1 - base_rate) / n0)
    design, w = np.stack([x, np.ones_like(x)], 1), np.array([0.3, 0.0])
    for _ in range(steps):
        p = _sigmoid(design @ w)
        slope = design.T @ (weight * (p - target))
        bend = design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
    return max(0.05, float(w[0])), float(w[1])


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that have its windows, and no others."""
    if len(text) <= langid.CHUNK:
        yield text
        return
    held: list[str] = []
    first = True
    for part in cut_long(text.lower()):
        c = letters_of(part)
        held += np.where(c == 0, np.uint32(32), c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()
        whole = len(held) // STRIDE * STRIDE
        if whole >= 2 * SPAN:
            yield " ".join(held[:whole])
            held, first = held[whole - (SPAN - STRIDE) :], False
    if first or len(held) > SPAN - STRIDE:
        yield " ".join(held)


def scorer(net: Network | None):
    """A function from a list of texts to their scores."""

    def score(texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), LOWEST)
        if net is None:
            return np.zeros(len(texts))
        held, size = [], 0
        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                held.append((k, piece))
                size += len(piece)
                if size > CHUNK:
                    run(best, held)
                    held, size = [], 0
        run(best, held)
        return _sigmoid(net.scale * best + net.shift)

    def run(best: np.ndarray, held: list[tuple[int, str]]) -> None:
        if held:
            text, word, grams = words_in([x for _, x in held])
            at, mask, of = windows_of(text)
            if len(at):
                np.maximum.at(best, np.array([k for k, _ in held])[of], net.forward(net.inputs(word, grams), at, mask).astype(np.float64))

    return score


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[list[tuple[str, int]], float]:
    """(text, toxic) of at most ``positives`` and ``negatives`` rows of labelled documents outside the held-out fold, and the share of
    toxic ones among all labelled documents there."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).select("doc_id", "toxic").distinct()
    total = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    found: list[tuple[str, int]] = []
    for v, bound in ((0, negatives), (1, positives)):
        ids = labelled.where(F.col("toxic") == v).select("doc_id", place("doc_id"))
        ids = ids.where(F.col("place") < share_of(bound, total.get(v, 0))).orderBy("place", "doc_id").limit(bound).select("doc_id")
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(place("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"))
        found += [(r.text, v) for r in rows.orderBy("place", "text").limit(bound).collect()]
    return found, total.get(1, 0) / max(1, sum(total.values()))


def score_documents(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    if net is None:
        rows, base_rate = training_rows(docs, labels)
        net = train(rows, base_rate=base_rate)
    model = docs.sparkSession.sparkContext.broadcast(net)  # tables of a fixed size, their rows that training touched

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for batch in batches:
            got = score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCORED)
