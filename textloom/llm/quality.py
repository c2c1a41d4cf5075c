"""Text quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes enter through an embedding. Filters of ``WIDTH`` bytes run over every place; their outputs (rectified) are
max-pooled over chunks of ``2 * BLOCK`` bytes, each overlapping the next by half, so that chunks cover the whole text. A dense
layer turns a chunk's pooled features into a vector; mean and maximum of a text's vectors go through a logistic layer into one
probability. Everything, filters and embedding included, is learned by Adam on labelled documents.

As pooling takes one place for each filter and block, the backward pass follows those places only. The filters are applied without
copying windows: bytes from place r on, seen as rows of ``WIDTH``, give the outputs of every ``WIDTH``-th place, for each r.

The labelled documents to learn from are bounded in rows (``LOW``, ``HIGH``: ordered limits, taken evenly over the table by hash) and read
whole, as texts are scored: a long text goes in pieces of whole blocks, each beginning with the last block of the one before.
A sixth of them is held back to fit the probability (Platt scaling, at the labels' base rate).

Defined cases: null and empty texts score as a text of padding alone; null doc_ids are never learned from and count as not held
out; without labels of both kinds every text scores 0; repeated rows each give a row; an empty table gives no rows; only doc_id and
text (and quality of labels) are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.langid import fold, place, share_of
from textloom.llm.toxicity import platt

WIDTH, BLOCK = 8, 128
DIM, FILTERS, HIDDEN = 4, 32, 16
PAD = 256
#: Labelled documents to learn from, at most: of low and of high quality.
LOW, HIGH = 1000, 1500
THRESHOLD = 0.3
#: Bytes that a task scores at once, and a long text's pieces: whole blocks.
PIECE = 1 << 19
SCORED = "doc_id long, held_out boolean, score double, predicted int"


class Network:
    """Parameters by name, and the probability's scale and shift."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embedding": normal(PAD + 1, DIM, scale=0.5),
            "filters": normal(WIDTH * DIM, FILTERS, scale=0.25),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "dense": normal(FILTERS, HIDDEN, scale=0.25),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(2 * HIDDEN, scale=0.25),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embedding"][PAD] = 0
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, data: np.ndarray, ends: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest output of each filter in each block of data (whole blocks of bytes, then WIDTH places more), and where it lies. ``ends``
        are the numbers of blocks up to each text's end, over which no filter reads."""
        blocks = (len(data) - WIDTH) // BLOCK
        x = self.p["embedding"][data]
        step = BLOCK // WIDTH
        best, at = None, None
        for r in range(WIDTH):
            out = x[r : r + blocks * BLOCK].reshape(blocks * step, WIDTH * DIM) @ self.p["filters"]
            out = out.reshape(blocks, step, FILTERS)
            if r:
                out[ends - 1, -1] = -np.inf
            top = out.max(1)
            if places:
                where = out.argmax(1) * WIDTH + r
                at = where if best is None else np.where(top > best, where, at)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + self.p["filter_bias"], 0), at

    def chunks(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.p["dense"] + self.p["dense_bias"], 0)


def padded(text: bytes, first: int = 0) -> np.ndarray:
    """Bytes from ``first`` on, filled up to whole blocks; at least WIDTH - 1 places of padding stand behind the last byte."""
    n = len(text) - first
    data = np.full(-(-(n + WIDTH - 1) // BLOCK) * BLOCK, PAD, np.int16)
    data[:n] = np.frombuffer(text, np.uint8, n, first)
    return data


def chunk_ends(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many blocks, one after another: each chunk's two blocks (one block twice where a text has only that), and its text."""
    of = np.repeat(np.arange(len(blocks)), blocks)
    first = np.flatnonzero(np.append(of[:-1] == of[1:], False) | (blocks[of] == 1))
    return first, np.where(blocks[of[first]] == 1, first, first + 1), of[first]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*parts, np.full(WIDTH, PAD, np.int16)])


class _Adam:
    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, grad: dict[str, np.ndarray], share: float) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            up = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
            self.net.p[k] -= (self.rate * share * up).astype(np.float32)
        self.net.p["embedding"][PAD] = 0


def loss_gradient(net: Network, parts: list[np.ndarray], truth: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the mean logistic loss over some texts (padded), and their logits."""
    p, data = net.p, joined(parts)
    blocks = np.array([len(x) // BLOCK for x in parts])
    h, at = net.pooled(data, blocks.cumsum(), places=True)
    one, two, of = chunk_ends(blocks)
    later = h[two] > h[one]
    pooled = np.where(later, h[two], h[one])
    u = net.chunks(pooled)
    n = np.bincount(of, minlength=len(parts))
    begin = np.concatenate([[0], n.cumsum()[:-1]])
    mean, top = np.add.reduceat(u, begin) / n[:, None], np.maximum.reduceat(u, begin)
    z = np.hstack([mean, top])
    logit = z @ p["out"] + p["out_bias"]
    d = ((1 / (1 + np.exp(-logit)) - truth) / len(parts)).astype(np.float32)
    grad = {"out": z.T @ d, "out_bias": d.sum(keepdims=True)}
    dz = d[:, None] * p["out"]
    ties = u == top[of]
    many = np.add.reduceat(ties.astype(np.float32), begin)
    du = ((dz[:, :HIDDEN] / n[:, None])[of] + np.where(ties, (dz[:, HIDDEN:] / many)[of], 0)) * (u > 0)
    grad["dense"], grad["dense_bias"] = pooled.T @ du, du.sum(0)
    dp = (du @ p["dense"].T) * (pooled > 0)
    dh = np.zeros_like(h)
    np.add.at(dh, one, np.where(later, 0, dp))
    np.add.at(dh, two, np.where(later, dp, 0))
    grad["filter_bias"] = dh.sum(0)
    b, f = np.nonzero(dh)
    value = dh[b, f]
    window = data[(b * BLOCK + at[b, f])[:, None] + np.arange(WIDTH)]
    order = np.argsort(f, kind="stable")
    seen = p["embedding"][window].reshape(len(b), WIDTH * DIM) * value[:, None]
    filters = np.zeros_like(p["filters"])
    for k, s, e in zip(*_runs(f[order])):
        filters[:, k] = seen[order[s:e]].sum(0)
    grad["filters"] = filters
    back = (p["filters"].T[f] * value[:, None]).reshape(-1, DIM)
    flat = window.reshape(-1)
    grad["embedding"] = np.stack([np.bincount(flat, back[:, k], PAD + 1) for k in range(DIM)], 1).astype(np.float32)
    return grad, logit


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return values[start].tolist(), start.tolist(), [*start[1:].tolist(), len(values)][: len(start)]


def train(rows: list[tuple[str | None, int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, base_rate: float | None = None, least_steps: int = 300, seed: int = 1) -> Network | None:
    """rows: (text, 0 or 1), with base_rate the share of ones where they come from. None without texts of both kinds."""
    label = np.array([y for _, y in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    parts = [padded((x or "").encode("utf-8", "surrogatepass")) for x, _ in rows]
    held = np.zeros(len(rows), bool)
    for v in (0, 1):  # a sixth of either kind is held back
        held[np.flatnonzero(label == v)[5::6]] = True
    learned = np.flatnonzero(~held)
    kinds = [learned[label[learned] == v] for v in (0, 1)]
    size = max(map(len, kinds))
    adam = _Adam(net, rate)
    epochs = max(epochs, -(-least_steps * batch // (2 * size)))
    for epoch in range(epochs):  # both kinds alike
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(k), size) for k in kinds]))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            grad, _ = loss_gradient(net, [parts[k] for k in some], label[some])
            adam.step(grad, 1 - epoch / epochs)
    if len(set(label[held].tolist())) == 2:
        raw = logits(net, [rows[k][0] for k in np.flatnonzero(held)])
        net.scale, net.shift = platt(raw, label[held], label.mean() if base_rate is None else base_rate)
    return net


def logits(net: Network, texts: list[str | None]) -> np.ndarray:
    """The network's value of each whole text."""
    total, top, count = np.zeros((len(texts), HIDDEN)), np.zeros((len(texts), HIDDEN)), np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def told() -> None:
        blocks = np.array([len(x) // BLOCK for x in parts])
        one, two, of = chunk_ends(blocks)
        h, _ = net.pooled(joined(parts), blocks.cumsum())
        owner = np.array(owners)[of]
        u = net.chunks(np.maximum(h[one], h[two]))
        np.add.at(total, owner, u)
        np.maximum.at(top, owner, u)
        np.add.at(count, owner, 1)

    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while len(raw) - at > PIECE + BLOCK:
            # filters at the end of a piece read on into the next
            data = np.frombuffer(raw, np.uint8, PIECE + WIDTH, at).astype(np.int16)
            h, _ = net.pooled(data, np.zeros(0, np.int64))
            u = net.chunks(np.maximum(h[:-1], h[1:]))
            total[k] += u.sum(0, dtype=np.float64)
            top[k] = np.maximum(top[k], u.max(0))
            count[k] += len(u)
            at += PIECE - BLOCK  # the piece's last block begins the next
        parts.append(padded(raw, at))
        owners.append(k)
        size += len(parts[-1])
        if size > PIECE:
            told()
            parts, owners, size = [], [], 0
    if parts:
        told()
    return np.hstack([total / np.maximum(count, 1)[:, None], top]) @ net.p["out"].astype(np.float64) + float(net.p["out_bias"][0])


def scorer(net: Network | None):
    """A function from a list of texts to their probabilities of high quality."""
    return lambda texts: np.zeros(len(texts)) if net is None else 1 / (1 + np.exp(-np.clip(net.scale * logits(net, texts) + net.shift, -700, 700)))


def training_rows(docs: DataFrame, labels: DataFrame, low: int = LOW, high: int = HIGH) -> tuple[list[tuple[str, int]], float]:
    """(text, quality) of at most ``low`` and ``high`` rows of labelled documents outside the held-out fold, texts whole, and the share of high
    quality among all labelled documents there."""
    labelled = labels.where(F.col("quality").isin(0, 1) & (fold() != 0)).select("doc_id", "quality").distinct()
    total = {r.quality: r["count"] for r in labelled.groupBy("quality").count().collect()}
    found: list[tuple[str, int]] = []
    for v, bound in ((0, low), (1, high)):
        ids = labelled.where(F.col("quality") == v).select("doc_id", place("doc_id"))
        ids = ids.where(F.col("place") < share_of(bound, total.get(v, 0))).orderBy("place", "doc_id").limit(bound).select("doc_id")
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(place("doc_id", "text"), "text")
        found += [(r.text, v) for r in rows.orderBy("place", "text").limit(bound).collect()]
    return found, total.get(1, 0) / max(1, sum(total.values()))


def score_documents(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    if net is None:
        rows, base_rate = training_rows(docs, labels)
        net = train(rows, base_rate=base_rate)
    model = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for batch in batches:
            got = score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCORED)
