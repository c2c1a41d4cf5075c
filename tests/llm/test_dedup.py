import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from textloom.llm import components, embed_dedup, exact_dedup, simhash, substring

LONG = " ".join(f"w{i}" for i in range(90))
ROWS = [
    (1, "a b\tc", "en"),
    (2, "ab c ", "en"),
    (3, None, None),
    (4, "", "fr"),
    (5, " \n", "fr"),
    (6, LONG, "en"),
    (7, "x " + LONG + " y", "en"),
    (7, "x " + LONG + " y", "en"),
    (None, "abc", "en"),
    (9, "ABC", "en"),
    (10, "é " * 60, "fr"),
    (11, "z" * 5000 + " q", None),
]


def table(spark, tmp_path, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_dedup(spark, tmp_path, capacity):
    docs = table(spark, tmp_path)
    got = exact_dedup.exact_dedup(docs, capacity).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for doc_id, text, _ in ROWS:
        groups.setdefault(key(text), []).append((-len(text or ""), doc_id is None, doc_id))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == (by_hash[r.text_sha256][0][2], len(by_hash[r.text_sha256]))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_hash.keys())
    kept = exact_dedup.drop_copies(docs, capacity)
    assert kept.columns == docs.columns and Counter(key(r.text) for r in kept.collect()) == Counter(groups.keys())


def test_chains_keep_colliding_bodies_apart():
    import pyarrow as pa

    rows = [(0, 5, b"one", 1, 1, 3, 1, 1), (0, 5, b"two", 2, 2, 3, 2, 2), (0, 5, b"one", 3, 4, 4, 3, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(8)], names=list("abcdefgh"))
    (out,) = exact_dedup._chains(iter([batch]))
    assert sorted(zip(out.column("rep").to_pylist(), out.column("keep_id").to_pylist(), out.column("group_size").to_pylist())) == [(1, 3, 5), (2, 2, 2), (3, 3, 5)]


def test_a_hot_text_is_merged_in_parts(spark, tmp_path, monkeypatch):
    """A text in a third of the rows, in many batches: no task reads more than about capacity of its bodies, and results are the same."""
    rows = [(i, "hot text" if i % 3 == 0 else f"cold {i % 50}", "x") for i in range(1200)]
    docs = table(spark, tmp_path, rows)
    seen = []
    real = exact_dedup.written

    def watched(df, name):
        out = real(df, name)
        if name == "dedup-leads":
            seen.extend(out.groupBy("lead").count().collect())
        return out

    monkeypatch.setattr(exact_dedup, "written", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = exact_dedup.exact_dedup(docs, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(text, []).append((-len(text), doc_id))
    best = {hashlib.sha256(key(t).encode()).hexdigest(): (min(g)[1], len(g)) for t, g in groups.items()}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: best[hashlib.sha256(key(t).encode()).hexdigest()] for i, t, _ in rows}
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(rows)
    assert len(seen) > 5 and max(r["count"] for r in seen) <= 64  # some 300 bodies in about 19 parts


def test_empty_tables(spark, tmp_path):
    docs = table(spark, tmp_path, [])
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert simhash.near_dedup(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(vectors).count() == 0


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def closure(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash(spark, tmp_path):
    docs = table(spark, tmp_path)
    got = simhash.near_dedup(docs).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter((i, simhash_by_hand(t)) for i, t, _ in ROWS)
    prints = sorted({int(r.fingerprint, 16) for r in got})
    label = closure(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    first = {}
    for r in got:
        root = label[prints.index(int(r.fingerprint, 16))]
        first.setdefault(root, set()).add(r.component_id)
    ids = {}
    for r in got:
        ids.setdefault(label[prints.index(int(r.fingerprint, 16))], []).append(r.doc_id)
    assert {k: {min((x for x in v if x is not None), default=None)} for k, v in ids.items()} == first
    assert sum(r.kept for r in got) == len(first) == simhash.drop_near_copies(docs).count()


@pytest.mark.parametrize("segment", [16, 2048])
def test_near_links_find_all_components(monkeypatch, segment):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    codes = set()
    for base in rng.integers(0, 1 << 62, 8):
        for _ in range(150):
            code = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 8)):
                code ^= 1 << int(bit)
            codes.add(code)
    codes = np.array(sorted(codes), np.uint64)
    monkeypatch.setattr(simhash, "SEGMENT", segment)
    monkeypatch.setattr(simhash, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))

    def gray(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    links, segments = [], []
    for turn in range(4):
        order = sorted(codes.tolist(), key=lambda c: gray(int(simhash.turned(np.array([c], np.uint64), turn)[0])))
        batch = pa.RecordBatch.from_arrays([pa.array([turn] * len(order), pa.int32()), pa.array(np.array(order, np.uint64).view(np.int64))], names=["turn", "code"])
        for out in simhash._in_ranges(iter([batch])):
            for r in out.to_pylist():
                if r["segment"] is None:
                    links.append((r["a"], r["b"]))
                else:
                    segments.append((r["turn"], r["block"], np.array(r["codes"], np.int64).view(np.uint64)))
    for i, (turn, block, one) in enumerate(segments):
        for other_turn, other_block, two in segments[i:]:
            if (turn, block) == (other_turn, other_block):
                a, b = simhash._links(one, None if one is two else two, turn)
                links += zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())
    place = {c: k for k, c in enumerate(codes.view(np.int64).tolist())}
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    node, root = simhash.stars(len(codes), near[:, 0], near[:, 1])
    expected = np.arange(len(codes))
    expected[node] = root
    node, root = simhash.stars(len(codes), np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]))
    found = np.arange(len(codes))
    found[node] = root
    assert (found == expected).all() and 1 < len(set(expected.tolist())) < len(codes)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20), (30, 31), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{k: 6 for k in range(6, 11)}, 30: 30, 31: 30, **{100 + i: 100 for i in range(41)}}


def removed_by_hand(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [(1, 50, 3), (4, 10_000, 1000), (substring.DISTINCT, substring.SHARD_WORDS, substring.STREAMED)])
def test_substring_dedup(spark, tmp_path, limits):
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{x}" for x in rng.integers(0, 50, 60))
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9, n))
    texts = [words(int(n)) + " " + shared[int(a) : int(a) + 230] + " " + words(20) for n, a in zip(rng.integers(0, 60, 25), rng.integers(0, 60, 25))]
    texts += [t for _, t, _ in ROWS] + ["a b " * 300, "same " * 34, "same " * 35, "same " * 36]
    docs = table(spark, tmp_path, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, *limits).collect()}
    assert got == dict(enumerate(removed_by_hand(texts)))


def test_substring_dedup_with_a_hot_anchor(spark, tmp_path):
    """10,500 texts share a gram that is in every window of theirs: a third of them are copies, the others differ around it."""
    rolling = substring._Rolling()
    common = min((" ".join(f"c{k}_{i}" for i in range(8)) for k in range(3000)), key=lambda g: int(rolling(substring.word_hashes(g.encode()), 8)[0]))
    around = lambda i: " ".join(str((i * 7 + j * 13) % 4000) for j in range(30))
    texts = [f"{around(0 if i % 3 == 0 else i % 3400)} {common} {around(0 if i % 3 == 0 else i + 5)}" for i in range(10_500)]
    docs = table(spark, tmp_path, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, 256, 5_000, 1_000).collect()}
    assert got == dict(enumerate(removed_by_hand(texts))) and any(0 < x[1] < x[0] for x in got.values())


def links_by_hand(rows):
    ok = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    unit = lambda v: np.array(v, float) / np.abs(np.array(v, float)).max() if ok(v) else None
    units = [unit(v) for v, _ in rows]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    return [
        (a, b) for a in range(len(rows)) for b in range(a)
        if rows[a][1] is not None and rows[a][1] == rows[b][1] and units[a] is not None and units[b] is not None
        and len(units[a]) == len(units[b]) and cos(units[a], units[b]) >= 0.98
    ]


@pytest.mark.parametrize("blocks", [(3, 4), (embed_dedup.CODE_BLOCK, embed_dedup.BLOCK)])
def test_embeddings(spark, monkeypatch, blocks):
    monkeypatch.setattr(embed_dedup, "CELL_SIZE", 2)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(15):
            rows.append(((centre + rng.normal(size=16) * 0.08).astype(np.float32).tolist(), c % 2))
    rows += [rows[0], rows[0], (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 0), ([1.0, None] * 8, 0), (rows[0][0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([], 1)]
    rows += [([1e300, 2e300], 0), ([1e-300, 2e-300], 0), ([3.0, -0.0], 0), ([3.0, 0.0], 0)]
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<double>, label int, row int, vector string")
    links = links_by_hand(rows)
    label, degree = closure(len(rows), links), Counter(x for link in links for x in link)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, 0.98, *blocks).collect()}
    assert got == {i: (degree[i], label[i], label[i] == i) for i in range(len(rows))}
    assert 0 < len(links) < len(rows) ** 2 / 4


@pytest.mark.parametrize("dim", [64, 768])
def test_the_estimate_decides_which_vectors_are_read(dim):
    """Pairs with cosines spread over 0.5 to 1: meeting leaves some, the estimate fewer, the vectors fewer still, and no link is lost."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(0.5, 1.0, 2000)
    y = cos[:, None] * x + np.sqrt(1 - cos**2)[:, None] * z
    turned = [u @ embed_dedup.rotation(dim) for u in (x, y)]
    codes = [(t > 0).astype(np.uint8) for t in turned]
    bits = 6
    a, b = (embed_dedup.keys(c, bits, 0.98) for c in codes)
    meet = (a == b).any(1)
    sides = []
    for u, t, c in zip((x, y), turned, codes):
        short, scale, loss = embed_dedup.shortened(u)
        packed = [r.tobytes() for r in np.packbits(c, axis=1, bitorder="little")]
        sides.append(embed_dedup.side(packed, np.abs(t).sum(1) / np.sqrt(t.shape[1]), [r.tobytes() for r in short], scale, loss, dim) | {"v": u})
    met = left = held = 0
    errors = []
    for i in np.flatnonzero(meet):
        one, two = ({k: v if k == "dim" else v[i : i + 1] for k, v in s.items()} for s in sides)
        table = int(np.flatnonzero(a[i] == b[i])[0])
        may = sum(len(p) for p, _ in embed_dedup.open_pairs(one, two, table, bits, 0.98))
        link = len(embed_dedup.linked(one, two, table, bits, 0.98)[0])
        met, left, held = met + 1, left + may, held + link
        assert link == int(x[i] @ y[i] >= 0.98) or abs(x[i] @ y[i] - 0.98) < 1e-9
        errors.append(float((one["code"][0] * 2.0 - 1) @ two["y"][0] / np.sqrt(turned[0].shape[1]) / one["factor"][0] - x[i] @ y[i]))
    assert held == (cos[meet] >= 0.98).sum() == (cos >= 0.98).sum()
    assert held < left < 0.35 * met  # the estimate alone drops most pairs that met
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(len(errors)) + 1e-3  # free of bias


def test_the_bound_holds(spark):
    """Pairs at the threshold itself, over many turns: none falls under its bound at a chance of one in a hundred more often than that."""
    rng = np.random.default_rng(3)
    for dim in (2, 16, 64):
        x = rng.normal(size=(3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
        t = x @ embed_dedup.rotation(dim)
        factor = np.abs(t).sum(1) / np.sqrt(t.shape[1])
        short, scale, loss = embed_dedup.shortened(y)
        estimate = (np.sign(t) * ((short * scale[:, None]) @ embed_dedup.rotation(dim))).sum(1) / np.sqrt(t.shape[1]) / factor
        bound = np.array([embed_dedup.least_estimate(factor[i : i + 1], loss[i : i + 1], dim, 0.98, 0.01)[0, 0] for i in range(len(x))])
        assert (estimate < bound).mean() <= 0.01


def test_embeddings_without_ids_and_repeated(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.001], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True)], key=str)


def test_embeddings_of_768_dimensions(spark, monkeypatch):
    """All links at the threshold's edge are found, with copies in a few dozen cells whatever the dimension."""
    monkeypatch.setattr(embed_dedup, "CELL_SIZE", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.975, 0.985, (600, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * y])
    df = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    links = sum(r.n_links for r in embed_dedup.near_vectors(df).collect())
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert links == ((unit @ unit.T) >= 0.98).sum() - len(v) and links > 400
    assert embed_dedup.tables_for(10, 768, 0.98) < 40 and embed_dedup.tables_for(20, 768, 0.98) < 100
