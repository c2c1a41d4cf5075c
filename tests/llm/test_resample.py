"""Importance resampling against n-grams put together one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice("abCZ09 .,\n\x00é漢🙂_") for _ in range(rnd.choice([0, 1, 5, 30, 400]))) for _ in range(40)]
    return [*made, None, "", "...", "x" * 5000, "a b " * 30, "a b " * 30]


@pytest.mark.parametrize("piece", [1 << 20, 50, 7])
@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_checksums_of_every_gram(monkeypatch, piece, most):
    monkeypatch.setattr(resample, "PIECE", piece)
    got, counted = {}, np.zeros(len(texts()), int)
    for n, owner, crc in resample.counted(texts(), most):
        counted += n
        for k, c in zip(owner.tolist(), crc.tolist()):
            got.setdefault(k, []).append(c)
    for k, text in enumerate(texts()):
        assert sorted(got.get(k, [])) == sorted(zlib.crc32(g.encode()) for g in grams(text, most))
        assert counted[k] == len(words(text))


def test_shifts():
    for by in (0, 1, 63, 64, 4097, 300_000):
        data = bytes([1, 2, 3]) + bytes(by)
        register = zlib.crc32(b"\x01\x02\x03") ^ 0xFFFFFFFF
        assert resample.shifted(np.array([register], np.uint32), np.array([by]))[0] == zlib.crc32(data) ^ 0xFFFFFFFF


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 64)])
def test_draws(spark, most, buckets):
    docs = [(i, t) for i, t in enumerate(texts())] + [(3, "c d e " * 9), (None, "a b c " * 9)] + [(100 + i, f"w{i % 7} w{i % 5} " * 12) for i in range(60)]
    target = ["w1 w2 w3 a b", None, "w1 W2"]
    got = resample.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets, percent=25, least_words=15
    ).collect()
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x, most)), Counter(bucket(g) for x in target for g in grams(x, most))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    wanted = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(x, most))
        wanted.append([i, len(grams(x, most)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 15])
    drawn = sorted((r for r in wanted if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: 25 * len(drawn) // 100])}
    assert rank
    assert sorted(map(str, map(tuple, got))) == sorted(str((*r[:4], rank.get(id(r)))) for r in wanted)
    none = resample.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert none.count() == 0
