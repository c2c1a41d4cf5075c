"""TF-IDF and its truncated SVD against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import embed


def matrix(texts, features):
    words = [(t or "").split() for t in texts]
    cf = {}
    for w in sum(words, []):
        cf[w] = cf.get(w, 0) + 1
    terms = sorted(sorted(cf, key=lambda t: (-cf[t], t))[:features])
    idf = np.array([np.log((1 + len(texts)) / (1 + sum(t in set(w) for w in words))) + 1 for t in terms])
    m = np.array([[w.count(t) for t in terms] for w in words]) * idf
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return terms, idf, np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def test_against_numpy(spark):
    rnd = random.Random(4)
    topics = [[f"{c}{i}" for i in range(8)] for c in "abcdef"]
    texts = [" ".join(rnd.choice(rnd.choice([topics[k % 6]] * 4 + topics)) for _ in range(rnd.randint(3, 30))) for k in range(240)] + [None, "", "unknownword"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    terms, idf, m = matrix(texts, 40)
    got = embed.fitted(docs, tokens, components=6, features=40, passes=8)
    assert got.terms == terms and np.allclose(got.idf, idf)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(got.values, s[:6], rtol=1e-3)
    assert np.allclose(np.abs((got.directions * vt[:6].T).sum(0)), 1, atol=0.05)  # the same directions
    vectors = {r.doc_id: np.array(r.embedding) for r in embed.embedded(docs, tokens, got).collect()}
    p = m @ got.directions
    for i in range(len(texts)):
        size = np.linalg.norm(p[i])
        assert np.allclose(vectors[i], p[i] / size if size else 0, atol=1e-9)
    assert not vectors[240].any() and not vectors[241].any()
    same = np.mean([vectors[a] @ vectors[a + 6] for a in range(0, 200)])
    other = np.mean([vectors[a] @ vectors[a + 5] for a in range(0, 200)])
    assert same > other + 0.2  # texts of one topic lie together


def test_nothing_to_fit(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    got = embed.fitted(docs, tokens)
    assert got.terms == [] and embed.embedded(docs, tokens, got).count() == 1
