import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bpe, langid, packing, pii, toxicity, warc

SF = "/root/testdata/sf0.01"
EDGE = [None, "", " ", "12 34", "ß", "'s I'll <|endoftext|> x", "ΟΔΟΣ Σ", "漢字🙂 a\x00b", "a" * 3000, "\n\n  x   y\t", "1²½ 3"]


def written(spark, tmp_path, texts, name="docs"):
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, held_out string").repartition(2).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_automaton_encodes_every_document_as_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    machine, library = bpe.automaton(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [r["text"] or "" for r in documents()]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = machine.encode(text)
        assert got == wanted.ids and machine.decode(got) == library.decode(wanted.ids, skip_special_tokens=False)
    ranges = sum(len(row[0]) for row in machine.rows.values())
    assert ranges == len(machine.cut) and len(machine.place) == len(machine.spelt) and len(machine.sets) > 1000


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_automaton_encodes_as_the_library(name):
    path = public_tokenizers.path(name)
    machine, library = bpe.automaton(path), Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aabàéßñ'tsredl. 1²½ \n\t\x85\xa0漢🙂Σİ<|>Z\x1c_-") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for text in texts + [t for t in EDGE if t]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert machine.encode(text) == ids
        assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.round_trip(written(spark, tmp_path, EDGE), path).collect():
        ids = library.encode(EDGE[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_best_multiset():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.best_multiset(counts, room)
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[length] for length, n in used.items())


@pytest.mark.parametrize("ids", [[], [0], [1, 65535, 0], [65536], [7, 200000, 3]])
def test_ids_of_any_vocabulary_keep_their_size(ids):
    held = packing._narrow(np.array(ids, "<u4").tobytes())
    assert packing._wide(held, len(ids)).tolist() == ids and len(held) == (4 if max(ids, default=0) > 65535 else 2) * len(ids)


def test_packing(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = EDGE + ["copy of one text " * 40] * 30 + ["lorem ipsum " * n for n in range(1, 1200, 77)]
    got = packing.pack(written(spark, tmp_path, texts), path).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for whole, found in [(len(ids[i]), p) for i, p in pieces.items()] + [(None, s) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 1024
    fills = [sum(n for _, n in s) for s in sequences.values()]
    assert len(pieces) == len(texts) and sum(1024 - f for f in fills if f & (f - 1)) <= 1024
    assert packing.pack(written(spark, tmp_path, [], "none"), path).count() == 0


def test_archive_round_trip(spark, tmp_path):
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, "<p>é\r\n\r\nWARC/1.1</p>" * 30, "z" * 300000]
    rows = [(i, f"http://a/{i}", h, "extra") for i, h in enumerate(html)] + [(4, "http://b", "y" * 100, None), (None, None, "y" * 100, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    manifest = warc.write_archives(pages, per_file=4)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    read = warc.read_archives(manifest).collect()
    got = [r for r in read if r.record_type != "warcinfo"]
    assert len(got) == len(rows) and len({r.record_id for r in read}) == len(read) == len(rows) + manifest.count()
    first = next(r for r in got if r.page_id == 4 and r.record_type == "response")
    for r in got:
        if r.page_id is not None and r.page_id != 4:
            payload = (html[r.page_id] or "").encode()
            assert (r.record_type, r.refers_to) == (("revisit", first.record_id) if r.page_id in (5, 6) else ("response", None))
            assert r.payload == (None if r.record_type == "revisit" else payload) and r.digest == hashlib.sha256(payload).hexdigest()
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 4) == [("response", None), ("revisit", first.record_id)]
    told = {(r.page_id, r.record_type): r for r in warc.archive_report(pages).collect()}
    assert len(told) == len(rows)
    for (page_id, kind), r in told.items():
        payload = (html[4 if page_id is None else page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), hashlib.sha256(payload).hexdigest(), 4 if kind == "revisit" else None)
    small = warc.write_archives(pages, file_bytes=150)
    assert small.count() > manifest.count() and sum(r.records for r in small.collect()) == len(rows)
    assert warc.archive_report(pages.where("page_id < 0")).count() == 0


def test_archive_frames_stand_alone():
    records = [warc.record_bytes(f"<urn:{i}>", i, "u", b"payload %d " % i * 50, "d") for i in range(600)]
    data = b"".join(warc.archive_frames(iter(records)))
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.archive_records(data)) == records
    assert len(data) < sum(map(len, records)) / 2


def spans_by_hand(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, match):
        d = [int(c) for c in match if c.isascii() and c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii(spark, tmp_path):
    texts = EDGE + ["a@b.c_d@e.f x@y.z@w.v 1.2.3.4.5.6.7.8 256.1.1.1 00.001.1.1", "😀 4111 1111 1111 1111 4111-1111-1111-1111, +1 (555) 123-4567) ++49 30 123456", "é@q.com ü4111111111111111", "9" * 3000 + " " + "a." * 3000 + "@"]
    texts += [f"word{'abcdefgh'[i]} Zanzibarian johann@mail.example.com other" for i in range(8)] + ["a Zanzibarian alone"] + ["nothing here at all"] * 60
    docs = written(spark, tmp_path, texts)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = spans_by_hand(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] not in ("term", "cut")] == [s for s in base.split(",") if s]
        assert got[i].n_email == base.count("email") and got[i].n_card == base.count("card")
    term, cut = texts[16].index("Zanz"), texts[16].index("other")
    assert f"term:{term}:{term + 11}" in got[16].spans and f"cut:{cut}:{cut + 5}" in got[16].spans and "term" not in got[len(texts) - 1].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[16] == "wordb [TERM] [EMAIL] " and clean[len(texts) - 1] == texts[-1] and clean[0] is None
    assert pii.find(written(spark, tmp_path, [], "none")).count() == 0


def disclosed_by_hand(texts, alpha=pii.ALPHA, beta=pii.BETA, support=pii.SUPPORT):
    """Spans term and cut of each text, from counts over all texts, text by text and entity by entity."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    holds, beside, around, standing, anywhere = {}, {}, {}, [], {}
    for row, text in enumerate(texts):
        for t in set(re.findall(r"[^\W\d_]{4,}", text.lower())):
            anywhere[t] = anywhere.get(t, 0) + 1
        blank = email.sub(lambda m: " " * len(m[0]), text)
        for span in filter(None, spans_by_hand(text).split(",")):
            kind, a, b = span.split(":")
            value = kind + ":" + (text[int(a) : int(b)].lower() if kind == "email" else text[int(a) : int(b)] if kind == "ip" else re.sub("[^0-9]", "", text[int(a) : int(b)]))
            holds.setdefault(value, set()).add(row)
            begin, end = max(0, int(a) - pii.REACH), min(len(text), int(b) + pii.REACH)
            for m in re.finditer(r"[^\W\d_]{4,}", blank[begin:end]):
                if (m.start() == 0 and begin > 0) or (m.end() == end - begin and end < len(text)):
                    continue
                term = m[0].lower()
                beside.setdefault((value, term), set()).add(row)
                around.setdefault((value, term), set()).add(blank[begin:end])
                standing.append((row, value, term, begin + m.start(), begin + m.end()))
    kinds = {}
    for (value, term), rows in beside.items():
        if len(around[value, term]) < support:
            continue
        told = np.log2(len(texts) * len(rows) / (anywhere[term] * len(holds[value])))
        content = np.log2(len(texts) / len(holds[value]))
        if told > 0 and told >= alpha * content:
            kinds[value, term] = "cut" if told >= beta * content - 1e-9 else "term"
    found = [set() for _ in texts]
    for row, value, term, a, b in standing:
        if (value, term) in kinds:
            found[row].add((a, b, kinds[value, term]))
    return [{(a, b, min(k for x, y, k in f if (x, y) == (a, b))) for a, b, _ in f} for f in found]


@pytest.mark.parametrize("alpha,beta,support", [(0.9, 1.0, 2), (0.5, 0.8, 2), (0.3, 0.9, 1)])
def test_disclosing_terms_against_counts_by_hand(spark, tmp_path, alpha, beta, support):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(3, 9))) for _ in range(70)]
    people = [(f"p{i}@mail.example.org" if i % 3 else f"+49 30 55512{i:02d}", f"Clue{chr(97 + i)}rian") for i in range(9)]
    texts = []
    for i in range(160):
        body = [rnd.choice(words) for _ in range(rnd.randint(2, 30))]
        if i % 2:
            who, clue = people[rnd.randrange(len(people))]
            at = rnd.randint(0, len(body))
            body[at:at] = [clue] * (rnd.random() < 0.8) + [who] + [clue] * (rnd.random() < 0.3)
        if i % 17 == 0:
            body.append(rnd.choice(people)[1])
        texts.append(" ".join(body))
    texts += texts[:4]
    wanted = disclosed_by_hand(texts, alpha, beta, support)
    got = [set() for _ in texts]
    for r in pii.find(written(spark, tmp_path, texts), alpha, beta, support).collect():
        got[r.doc_id] = {(int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("term", "cut")}
    assert got == wanted and sum(map(len, wanted)) > 20


def test_column_names_with_backticks(spark, tmp_path):
    docs = written(spark, tmp_path, ["mail a@b.org"]).withColumn("odd`name", F.lit(1))
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).first()["text"] == "mail [EMAIL]"


def test_copies_are_no_evidence(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(40))
    texts = [f"{body} {i} " + "padding here and there to part it " * 3 + "Quixotania mona@example.org Barataria" for i in range(20)] + ["quite another text"] * 50
    assert not any("term" in r.spans or "cut" in r.spans for r in pii.find(written(spark, tmp_path, texts)).collect())


def test_terms_anywhere_in_a_text_with_the_entity(spark, tmp_path):
    """Far before, far behind, where 60 characters end, and longer than that; not in texts without the entity."""
    letters, long = "abcdefgh", "Llanfair" * 12
    far = [" ".join(f"{a}{b}" for b in "abcdefghijklmnopqrstuvwxyz" * 40) for a in letters]
    edge = lambda a: "Zanzibarian " + a * 3 + " xy" * 15 + " "
    texts = [f"Quixotania {far[i]} {edge(a)}johann@mail.example.com {far[i]} {long} {far[i]} BARATARIA" for i, a in enumerate(letters)]
    assert texts[0].index("johann") - texts[0].index("Zanzibarian") == 61 and min(map(len, texts)) > 9000
    texts += ["quixotania, barataria and Zanzibarian alone"] + ["nothing here at all"] * 90
    docs = written(spark, tmp_path, texts)
    got = {r.doc_id: r.spans.split(",") for r in pii.find(docs).collect()}
    for i in range(len(letters)):
        places = [(texts[i].index(t), len(t), k) for t, k in (("Quixotania", "term"), ("Zanzibarian", "term"), (long, "cut"), ("BARATARIA", "term"))]
        assert {f"{k}:{a}:{a + n}" for a, n, k in places} == {s for s in got[i] if not s.startswith("email")}
    assert all(got[i] == [""] for i in range(len(letters), len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0].startswith("[TERM] aa") and clean[0].endswith("az [TERM]") and "Llan" not in clean[0] and clean[8] == texts[8]


def test_a_text_with_20000_addresses(spark, tmp_path):
    text = " ".join(f"person{i} Thornbury p{i}@example{i % 7}.org, tel +1 555 {1000000 + i}" for i in range(20_000))
    docs = written(spark, tmp_path, [text, "short a@b.c", "x"])
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[0].n_email, got[0].n_phone) == (20_000, 20_000)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0].count("[EMAIL]") == 20_000 and "@" not in clean[0] and clean[0].startswith("person0 ") and clean[0].endswith("[PHONE]") and clean[1] == "short [EMAIL]"


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_language_id(spark, tmp_path):
    rows = documents()
    model = langid.train([(r["text"], r["lang"]) for r in rows if fold(r["doc_id"])])
    held = [r for r in rows if not fold(r["doc_id"])]
    got = langid.scorer(model)([r["text"] for r in held])
    assert np.mean([g[0] == r["lang"] for g, r in zip(got, held)]) > 0.98 and np.mean([g[2] for g in got]) < 0.01
    alone = [langid.scorer(model)([r["text"]])[0] for r in held[:20]]
    assert [g[0] for g in alone] == [g[0] for g in got[:20]] and np.allclose([g[1] for g in alone], [g[1] for g in got[:20]])
    docs = written(spark, tmp_path, EDGE)
    told = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert sorted(i for i, r in told.items() if r.lang_pred == "und") == [i for i, t in enumerate(EDGE) if not t or not any(map(str.isalpha, t))]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in told.items() if not r.rejected}
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_language_id_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out and true[r.doc_id]]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in got]) > 0.98 and all(fold(r.doc_id) == 0 for r in got)


def words_by_hand(text):
    """Runs of letters, lower-cased; longer ones than CHUNK are several."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [w[i : i + langid.CHUNK] for w in words for i in range(0, len(w), langid.CHUNK)]


def scored_by_hand(model, text):
    """(language, probability) from the words one after another."""
    buckets, mask = len(model.weights), (1 << 32) - 1

    def mixed(h, bits=32):
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & (1 << bits) - 1
        return (h ^ (h >> 13)) % buckets

    ids = []
    for word in words_by_hand(text):
        shown = [0, *map(ord, word), 0]
        for n in range(1, 5):
            for i in range(len(shown) - n + 1):
                part = shown[i : i + n]
                if (part[0] or part[-1]) and all(part[1:-1]) or n == 3 and part[1]:
                    h = 0
                    for k, c in enumerate(part):
                        h = (h * 0x9E3779B1 + c + k + 1) & mask
                    ids.append(mixed(h))
        ids.append(mixed(sum(ord(c) * pow(0x01000193, i % 64 + 1, 1 << 32) & mask for i, c in enumerate(word)) ^ 0xA5A5A5A5, 64))
    if not ids:
        return "und", 0.0
    p = langid.softmax((model.weights[ids].mean(0) + model.bias) / model.temperature)
    return model.langs[int(p.argmax())], float(p.max())


def test_language_scores_are_those_of_a_plain_computation(monkeypatch):
    rows = documents()
    model = langid.train([(r["text"], r["lang"]) for r in rows[:200]])
    texts = [r["text"] for r in rows[200:260]] + EDGE + ["\n".join("mot" * (i % 9) + "é" * (i % 5) for i in range(700)), "Straße" * 90 + "\nwort"]
    for chunk in (1 << 18, 700):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for (lang, score, _), text in zip(langid.scorer(model)(texts), texts):
            wanted = scored_by_hand(model, text)
            assert lang == wanted[0] and abs(score - wanted[1]) < 1e-5
    monkeypatch.setattr(langid, "CHUNK", 1 << 18)
    long = "un mot après l'autre\n" * 40_000  # over CHUNK, and no blank but line ends near a cut
    (lang, score, _), one = langid.scorer(model)([long])[0], langid.scorer(model)([long[: 21 * 1000]])[0]
    assert lang == one[0] and abs(score - one[1]) < 1e-6


def test_samples_are_bounded(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id", F.lit(" word" * 4000)).alias("text"), F.lit("en").alias("lang"))
    got = langid.training_rows(docs, "lang", 50).collect()
    assert len(got) == 50 and min(len(r.text) for r in got) > 20_000  # whole texts
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows, rate = toxicity.training_rows(docs, labels, 30, 40)
    assert sum(y for _, y in rows) <= 30 and 40 < len(rows) <= 70 and min(len(t) for t, _ in rows) > 20_000 and 0 < rate < 1
    assert langid.training_rows(docs.limit(0), "lang").count() == 0 and toxicity.training_rows(docs.limit(0), labels)[0] == []


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    x = rng.normal(size=(40, toxicity.WORD_DIM + toxicity.GRAM_DIM))
    at, mask, truth = rng.integers(0, 40, (5, toxicity.SPAN)), np.arange(toxicity.SPAN) < rng.integers(1, toxicity.SPAN + 1, 5)[:, None], rng.integers(0, 2, 5)

    def loss():
        z = net.forward(x, at, mask).astype(np.float64)
        return (np.logaddexp(0, z) - truth * z).sum()

    logit, held = net.forward(x, at, mask, keep=True)
    grad, dx = net.backward(held, toxicity._sigmoid(logit) - truth)
    for name, a, g in [(k, net.dense[k], grad[k]) for k in grad] + [("x", x, dx)]:
        place = np.unravel_index(np.abs(g).argmax(), a.shape)
        old = a[place]
        a[place] = old + 1e-2
        up = loss()
        a[place] = old - 1e-2
        down = loss()
        a[place] = old
        assert np.isclose((up - down) / 2e-2, g[place], rtol=0.05, atol=2e-3), name


def test_toxicity(spark, tmp_path):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rude = ["zorkish", "vexaly", "vexamo", "vexuri"]
    rows = [(text(rnd.randint(3, 120)) + (" " + rnd.choice(rude) + " " + text(5) if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(600)]
    net = toxicity.train(rows[:450], epochs=4)
    score = toxicity.scorer(net)
    got = score([t for t, _ in rows[450:]])
    truth = np.array([y for _, y in rows[450:]])
    assert ((got >= 0.5) == truth).mean() > 0.95
    assert np.allclose(score([rows[450][0], None, "1 2"])[0], got[0], atol=1e-5)
    assert (score([None, "", "12"]) < 0.5).all()
    docs = written(spark, tmp_path, EDGE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, labels).collect()] == [0.0] * len(EDGE)
    assert toxicity.score_documents(docs, labels, net).count() == len(EDGE)


def test_toxic_scores_are_those_of_a_plain_computation(monkeypatch):
    """Window by window and word by word, whatever pieces a long text is read in."""
    net = toxicity.Network(2)
    rng = np.random.default_rng(2)
    net.words, net.grams = rng.normal(0, 1, net.words.shape).astype(np.float32), rng.normal(0, 1, net.grams.shape).astype(np.float32)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    mask = (1 << 32) - 1

    def mixed(h, buckets, bits=32):
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & (1 << bits) - 1
        h = ((h ^ (h >> 12)) * 0x297A2D39) & (1 << bits) - 1
        return (h ^ (h >> 15)) & (buckets - 1)

    def entered(word):
        shown, sum_ = [0, *map(ord, word), 0], np.zeros(toxicity.GRAM_DIM)
        for n in toxicity.GRAMS:
            for i in range(len(shown) - n + 1):
                h = n
                for c in shown[i : i + n]:
                    h = (h * 0x9E3779B1 + c) & mask
                sum_ += net.grams[mixed(h, toxicity.GRAM_BUCKETS)]
        whole = sum(ord(c) * pow(0x01000193, i % 64 + 1, 1 << 32) & mask for i, c in enumerate(word))
        return np.concatenate([net.words[mixed(whole, toxicity.WORD_BUCKETS, 64)], toxicity.GRAM_SCALE * sum_])

    def read(xs, d):
        p, h, out = net.dense, np.zeros(toxicity.HIDDEN), []
        for x in xs:
            a, u, n = x @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"], toxicity.HIDDEN
            z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
            out.append(h)
        return out

    def by_hand(text):
        words = words_by_hand(text)
        best = toxicity.LOWEST
        for start in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE) if words else ():
            xs = [entered(w) for w in words[start : start + toxicity.SPAN]]
            states = np.array([np.concatenate(s) for s in zip(read(xs, "f"), read(xs[::-1], "b")[::-1])])
            e = np.tanh(states @ net.dense["Wa"] + net.dense["ba"]) @ net.dense["va"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ states @ net.dense["wo"] + net.dense["bo"][0]))
        return float(sigmoid(net.scale * best + net.shift))

    texts = [r["text"] for r in documents()[:12]] + EDGE + [" ".join(f"w{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 7)}" for i in range(n)) for n in (8, 9, 16, 17, 24, 25, 300, 411)]
    texts += ["1234 " * 500 + "end of it", "x" * 900 + " y"]
    for chunk in (1 << 18, 300):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(toxicity.scorer(net)(texts), [by_hand(t) for t in texts], atol=2e-5)


def test_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).where("held_out").collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if r.doc_id in got}
    found = [got[i] for i, y in truth.items() if y]
    clean = [got[i] for i, y in truth.items() if not y]
    assert np.mean(found) > 0.85 and np.mean(clean) < 0.01


def test_windows_overlap_and_cover():
    text = np.array([0] * 3 + [2] * 16 + [3] * 17 + [5] * 40)
    at, mask, of = toxicity.windows_of(text)
    assert set(at[mask].tolist()) == set(range(len(text)))
    assert [int((of == k).sum()) for k in (0, 2, 3, 5)] == [1, 1, 2, 4]
    assert all((text[at[i][mask[i]]] == of[i]).all() for i in range(len(at)))
