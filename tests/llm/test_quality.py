"""The byte network: gradients, pieces of long texts, held-out documents."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import quality


def by_hand(net, text):
    """The network's value, place by place and chunk by chunk."""
    raw = list((text or "").encode("utf-8", "surrogatepass"))
    size = max(1, -(-(len(raw) + quality.WIDTH - 1) // quality.BLOCK)) * quality.BLOCK
    x = net.p["embedding"].astype(np.float64)[raw + [quality.PAD] * (size - len(raw))]
    out = np.array([np.maximum(x[i : i + quality.WIDTH].reshape(-1) @ net.p["filters"] + net.p["filter_bias"], 0) for i in range(size - quality.WIDTH + 1)])
    chunk = 2 * quality.BLOCK
    starts = range(0, max(1, size - quality.BLOCK), quality.BLOCK)
    u = np.array([np.maximum(out[s : s + chunk].max(0) @ net.p["dense"] + net.p["dense_bias"], 0) for s in starts])
    return float(np.concatenate([u.mean(0), u.max(0)]) @ net.p["out"] + net.p["out_bias"][0])


TEXTS = [None, "", "a", "é漢🙂" * 9, "x" * 120, "y" * 121, "z" * 122, "ab " * 200, "".join(chr(97 + i * i % 26) for i in range(3000))]


def test_values_are_those_of_a_plain_computation(monkeypatch):
    net = quality.Network(5)
    net.p["filter_bias"] += 0.1
    wanted = [by_hand(net, t) for t in TEXTS]
    for piece in (1 << 19, 2 * quality.BLOCK, 4 * quality.BLOCK):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.allclose(quality.logits(net, TEXTS), wanted, atol=1e-4)
        assert np.allclose([quality.logits(net, [t])[0] for t in TEXTS], wanted, atol=1e-4)


def test_gradients():
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["filter_bias"] += 0.1  # away from the kink, where texts of padding lie
    parts = [quality.padded(x) for x in (b"hello world " * 30, b"", "é漢 abc".encode() * 80)]
    truth = np.array([1, 0, 1])

    def loss():
        _, z = quality.loss_gradient(net, parts, truth)
        return np.mean(np.logaddexp(0, z) - truth * z)

    grad, _ = quality.loss_gradient(net, parts, truth)
    for name, value in net.p.items():
        for place in np.argsort(-np.abs(grad[name]), axis=None)[:4]:
            at = np.unravel_index(place, value.shape)
            if name == "embedding" and at[0] == quality.PAD:
                continue
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-4, name


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).where("held_out").collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect() if r.doc_id in got}
    assert np.mean([got[i] for i, y in truth.items() if y]) > 0.99  # good documents are kept
    assert np.mean([1 - got[i] for i, y in truth.items() if not y]) > 0.85


def test_labels_of_one_kind_and_bounds(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id", F.lit(" word" * 9000)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in quality.score_documents(docs, labels).collect()} == {0.0}
    rows, rate = quality.training_rows(docs, labels.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), 20, 30)
    assert sum(y for _, y in rows) == 30 and len(rows) == 50 and min(len(t) for t, _ in rows) > 45_000 and 0.4 < rate < 0.6
    assert quality.training_rows(docs.limit(0), labels)[0] == []
