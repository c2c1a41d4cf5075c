import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import chunk as C
from textloom.operators import evaluate as E
from textloom.operators import gateway as G
from textloom.operators import index as I
from textloom.operators import logs as L
from textloom.operators import search as S
from textloom.operators import state as St
from textloom.sources import store, tables
from textloom.sources.snapshot import SnapshotTable


def rows(df):
    return sorted(map(tuple, df.collect()))


def okapi(docs, query, floor):
    n, lengths = len(docs), {k: len(v) for k, v in docs.items()}
    mean = sum(lengths.values()) / n
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    if floor:
        low = 0.25 * sum(idf.values()) / len(idf)
        idf = {w: low if v < 0 else v for w, v in idf.items()}
    out = {}
    for k, words in docs.items():
        for q in query:
            if q in words:
                tf = words.count(q)
                out[k] = out.get(k, 0) + idf[q] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[k] / mean))
    return out


@pytest.mark.parametrize("floor", [True, False])
def test_bm25(spark, floor):
    texts = {0: "red apple pie", 1: "red red wine", 2: "green apple", 3: "red car red road red", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = I.build(docs, X.tokens("text"))
    query = ["red", "apple", "red", "absent"]
    got = {r.doc_id: r.score for r in I.score(index, query, floor=floor).collect()}
    expected = okapi({k: t.split() for k, t in texts.items()}, query, floor)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    only = I.score(index, query, floor=floor, where=docs.where("doc_id < 2")).collect()
    assert {r.doc_id for r in only} == {0, 1} and I.score(index, []).count() == 0


def zipf_texts(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    return {i: " ".join(words[min(79, int(rnd.paretovariate(0.7)) - 1)] for _ in range(rnd.choice([0, 3, 12, 50]))) for i in range(n)}


def best(docs, query, k, floor=True):
    got = {i: round(s, 6) for i, s in okapi(docs, query, floor).items()}
    return sorted(got.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_stored_bm25_skips_blocks_and_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "GROUP", 8)
    monkeypatch.setattr(I, "FIRST_GROUPS", 3)
    texts = zipf_texts(600)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = I.StoredIndex(spark, f"file://{tmp_path}/i")
    index.upsert(docs, X.tokens("text"))
    split = {i: t.split() for i, t in texts.items()}
    queries = (["wza"], ["waa", "wfa", "wbc", "wfa"], ["wab"], ["none"], [])
    for query in queries:
        for floor, k in ((True, 5), (False, 3), (True, 1000)):
            got = [tuple(r) for r in index.search(query, k, floor=floor).collect()]
            assert got == best(split, query, k, floor)
    opened, total = index.blocks_read(["wza"], 1)
    assert opened < total
    only = [r.doc_id for r in index.search(["waa"], 4, where=docs.where("doc_id % 3 = 0")).collect()]
    assert only == [i for i, _ in best(split, ["waa"], 600) if i % 3 == 0][:4]
    monkeypatch.setattr(I, "NAMED_GROUPS", 1)
    assert [tuple(r) for r in index.search(["waa", "wfa"], 5).collect()] == best(split, ["waa", "wfa"], 5)


def test_stored_bm25_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MOST_SEGMENTS", 2)
    now = dict(zipf_texts(60))
    index = I.StoredIndex(spark, f"file://{tmp_path}/i")
    table = lambda some: spark.createDataFrame(list(some.items()), "doc_id long, text string")
    index.upsert(table(now), X.tokens("text"))
    for step in range(2):
        new = {i: zipf_texts(90, step + 1)[i] for i in range(step * 10, step * 10 + 35)}
        index.upsert(table(new), X.tokens("text"))
        now |= new
        gone = [step * 7, step * 7 + 1, 10_000]
        index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: t for i, t in now.items() if i not in gone}
        for query in (["waa", "wcb"], ["wza"]):
            assert [tuple(r) for r in index.search(query, 10).collect()] == best({i: t.split() for i, t in now.items()}, query, 10)
    assert index.segments <= 2
    index.upsert(spark.createDataFrame([(None, "wza wza wzz")], "doc_id long, text string"), X.tokens("text"))
    index.upsert(spark.createDataFrame([(None, "wzz")], "doc_id long, text string"), X.tokens("text"))
    assert index.search(["wzz"], 9).count() == 1
    index.remove(spark.createDataFrame([(None,)], "doc_id long"))
    assert index.search(["wzz"], 9).count() == 0


def test_replaced_files_make_a_new_index(spark, tmp_path):
    from textloom.plans import retrieval

    docs = lambda text: spark.createDataFrame([(1, text), (2, "plain words"), (3, "some other words")], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    docs("worthless erin")
    assert [r.doc_id for r in retrieval.bm25_search(spark, str(tmp_path)).collect()] == [1]
    name = next(p for p in (tmp_path / "documents.parquet").iterdir() if p.suffix == ".parquet")
    spark.createDataFrame([(1, "nothing of it"), (2, "worthless words"), (3, "some other words")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/new")
    next(p for p in (tmp_path / "new").iterdir() if p.suffix == ".parquet").replace(name)
    (tmp_path / "documents.parquet" / f".{name.name}.crc").unlink(missing_ok=True)
    assert [r.doc_id for r in retrieval.bm25_search(spark, str(tmp_path)).collect()] == [2]


def hits(spark, pairs, name="score"):
    return spark.createDataFrame(pairs, f"k string, {name} double")


def test_fusion(spark):
    v = S.ranked(hits(spark, [("a", 0.9), ("b", 0.8)]), "score", "k", 5)
    w = S.ranked(hits(spark, [("b", 9.0), ("c", 5.0)]), "score", "k", 5)
    got = [tuple(r) for r in S.reciprocal_rank_fusion(v, w, "k", 5).collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 6), "both"), ("a", round(1 / 61, 6), "vector"), ("c", round(1 / 62, 6), "bm25")]
    assert [r.match_type for r in S.reciprocal_rank_fusion(v, w.where("rank < 0"), "k", 5).collect()] == ["vector", "vector"]
    assert rows(S.linear_fusion(v, w, "k", 5, 3, 0)) == [("a", 0.9), ("b", 0.8), ("c", 0.0)]
    assert rows(S.min_max(hits(spark, [("a", 2.0), ("b", 2.0)])).select("k", "normalised")) == [("a", 1.0), ("b", 1.0)]
    third = hits(spark, [("a", 0.1), ("d", 0.4)])
    assert rows(S.merge_three(v, hits(spark, [("b", 0.6), ("c", 0.5)]), third, "k", 9)) == [("a", 0.99, "vector+third"), ("b", 0.7, "vector+bm25"), ("c", 0.5, "bm25"), ("d", 0.4, "third")]
    assert rows(S.with_fallback(v.limit(0), v, w, "k", 5)) == [("a", 0.9), ("b", 0.8)]
    assert rows(S.with_fallback(v.limit(0), v.limit(0), w, "k", 5)) == [("b", 9.0), ("c", 5.0)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "XY", 9)], "id int, s string, n int")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(S.matches({})) == [1, 2, 3] and ids(S.matches({"s": ["x", "y"], "n": {"$gte": 5}})) == [1] and ids(S.matches({"n": {"$nin": [5]}})) == [3]
    assert ids(S.loosely_matches({"s": "x"}, dict(df.dtypes))) == [1, 3] and ids(S.loosely_matches({"gone": 1}, dict(df.dtypes))) == []


texts = st.text(alphabet="ab .。\n#;'", max_size=3000)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(0, 5))
def test_packers_end_and_lose_nothing(text, k):
    text = text * (k + 1)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(C.sql_statements(text.replace("'", "")))) == squeeze(text.replace("'", "").replace(";", ""))
    assert squeeze("".join(C.sentence_pack(text))) == squeeze(text)
    assert squeeze("".join(C.merged_paragraphs(text.split("\n")))) == squeeze(text)
    whole = list(C.force_split(text))
    assert all(len(p) <= 2000 + 200 for p in whole) and (not text or whole[0][:50] == text[:50])
    assert sum(map(len, whole)) >= len(text)
    windows = list(C.sentence_windows(text))
    assert all(len(w) <= 1000 for w in windows) and sum(map(len, windows)) >= len(text) - 100


def test_markdown_sections():
    text = "# T\nintro " + "i" * 300 + "\n## A\nshort\n## B\n" + "b " * 1500
    got = list(C.markdown_sections(text))
    assert [h for h, _ in got][:1] == ["T"] and "## A\nshort" in got[0][1] and {h for h, _ in got[1:]} == {"B"}
    assert list(C.sql_statements("a ';' b; c;; d")) == ["a ';' b", "c", "d"]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 4000), (2, ""), (3, "ab " * 100)], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_index, len(r.chunk)) for r in C.fixed_windows(docs).orderBy("doc_id", "chunk_index").collect()] == [(1, 0, 2000), (1, 1, 2000), (1, 2, 300), (3, 0, 300)]
    words = spark.createDataFrame([(1, "w " * 2000)], "doc_id long, text string")
    assert [len(r.chunk.split()) for r in C.word_windows(words).orderBy("chunk_index").collect()] == [750, 750, 724, 86]
    over = C.with_overlap(C.fixed_windows(docs)).orderBy("doc_id", "chunk_index").collect()
    assert over[0].chunk == "x" * 2000 and over[1].chunk == "..." + "x" * 150 + "\n" + "x" * 2000
    assert {r.packer for r in C.routed(spark.createDataFrame([("a.md",), ("b.SQL",), ("c.txt",), ("d",)], "path string")).collect()} == {"markdown", "sql", "paragraphs", "force"}


def test_state(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = dict(rows(St.rebuilt(ids("keep1", "keep2", "stale1", "stale2"), ids("keep1", "keep2", "new1"), ids("ddl1"))))
    assert got == {"keep1": "kept", "keep2": "kept", "stale1": "removed", "stale2": "removed", "new1": "added", "ddl1": "added"}
    files = lambda *x: spark.createDataFrame(list(x), "path string, fp string")
    old, new = files(("a", "1"), ("b", "2"), ("c", "3")), files(("a", "1"), ("b", "9"), ("d", "4"))
    assert dict(rows(St.changes(old, new))) == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    assert rows(St.todo(new, old)) == [("b", "9"), ("d", "4")]
    assert rows(store.upserted(old, new, ["path"])) == [("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")] and rows(store.without(old, new, ["path"])) == [("c", "3")]
    assert rows(St.duplicate_pairs(spark.createDataFrame([(1, "x"), (3, "x"), (2, "x"), (4, "y")], "id int, h string"), "h", "id").select("original", "duplicate")) == [(1, 2), (1, 3)]


def test_versioned_table(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", ["id"])
    row = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    assert t.read() is None
    t.upsert(row((1, "a"), (2, "b")))
    t.upsert(row((2, "c"), (3, "d")))
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    t.delete(row((1, "")))
    assert rows(t.read()) == [(2, "c"), (3, "d")] and t.versions() == [0, 1, 2]


@pytest.mark.parametrize("width,stride", [(2000, 1850), (10, 3), (7, 7), (5, 9)])
def test_fixed_windows_are_the_text_s_substrings(spark, width, stride):
    texts = ["", "a", "é🙂\n" * 40, "x" * 1850, "y" * 1851, "0123456789" * 700, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [(i, k, t[s : s + width]) for i, t in enumerate(texts) for k, s in enumerate(range(0, len(t or ""), stride))]
    assert sorted(map(tuple, C.fixed_windows(docs, width, stride, 1).collect())) == wanted


def test_windows_of_a_long_text_take_linear_time(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 400_000).alias("text"))
    C.fixed_windows(docs.limit(0)).count()
    began = time.perf_counter()
    assert C.fixed_windows(docs).agg(F.sum(F.length("chunk"))).first()[0] > 4_000_000
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "sql,wanted",
    [
        ("SELECT * FROM orders o JOIN nation ON x = y", "SELECT * FROM shop.orders o JOIN geo.nation ON x = y"),
        ("WITH orders AS (SELECT * FROM orders) SELECT * FROM orders", "WITH orders AS (SELECT * FROM shop.orders) SELECT * FROM orders"),
        ("WITH a AS (SELECT 1), b AS (SELECT * FROM a, nation) SELECT * FROM b JOIN a JOIN orders", "WITH a AS (SELECT 1), b AS (SELECT * FROM a, geo.nation) SELECT * FROM b JOIN a JOIN shop.orders"),
        ("SELECT 'FROM orders' AS x /* JOIN nation */ FROM nation -- FROM orders", "SELECT 'FROM orders' AS x /* JOIN nation */ FROM geo.nation -- FROM orders"),
        ("SELECT (SELECT max(k) FROM orders) m FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE nation.k = 1) AND k IN (SELECT k FROM `nation`)", "SELECT (SELECT max(k) FROM shop.orders) m FROM geo.nation WHERE EXISTS (SELECT 1 FROM shop.orders WHERE nation.k = 1) AND k IN (SELECT k FROM geo.`nation`)"),
        ("SELECT * FROM dm.orders UNION SELECT * FROM `dm`.nation UNION SELECT * FROM other.orders", "SELECT * FROM data.orders UNION SELECT * FROM data.nation UNION SELECT * FROM other.orders"),
        ("SELECT '😀', extract(year FROM d) FROM orders, (WITH nation AS (SELECT 1) SELECT * FROM nation) s, nation", "SELECT '😀', extract(year FROM d) FROM shop.orders, (WITH nation AS (SELECT 1) SELECT * FROM nation) s, geo.nation"),
        ("SELECT orders.k FROM elsewhere AS orders", "SELECT orders.k FROM elsewhere AS orders"),
    ],
)
def test_tables_are_qualified_where_the_parser_finds_them(spark, sql, wanted):
    assert G.qualified(sql, {"orders": "shop", "nation": "geo"}, {"dm": "data"}) == wanted


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 据。.!?！\n", max_size=400), st.integers(1, 6), st.integers(0, 3))
def test_cascade_covers_the_text_within_its_bounds(text, budget, times):
    text = text * (1 + times)
    most = 2 * budget
    got = list(C.separator_cascade(text, budget, most))
    bare = lambda s: "".join(c for c in s if c not in " \n.!?。！？")
    assert bare("".join(got)) == bare(text)
    assert all(C.weight(c) <= most or len(c) <= 4 * budget for c in got) and all(c.strip() for c in got)


def test_cascade():
    assert list(C.separator_cascade("  a  b\n")) == ["a b"] and list(C.separator_cascade(" \n")) == []
    sentence = "one two three four. "
    assert list(C.separator_cascade(sentence * 5, budget=8, most=16)) == ["one two three four。one two three four"] * 2 + ["one two three four"]  # one part too heavy, so sentences
    assert list(C.separator_cascade(sentence * 3, budget=8, most=16)) == [(sentence * 3).strip()]  # within most: stays whole
    assert list(C.separator_cascade("数据" * 10, budget=4, most=8)) == ["数据" * 8, "数据" * 2]
    began = time.perf_counter()
    assert sum(map(len, C.separator_cascade("some words of a sentence. " * 80_000))) > 1_900_000
    assert time.perf_counter() - began < 20


def test_sources(spark, tmp_path):
    for name, text in {"a.md": "x" * 60, "b.txt": "y" * 10, "test_c.py": "z" * 99, "node_modules/d.md": "q" * 99, "sub/e.md": "é" * 60}.items():
        p = tmp_path / "files" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = tables.decoded(tables.scan_files(spark, [str(tmp_path / "files")], [".md", ".txt", ".py"]))
    assert sorted((r.name, r.text, r.is_text) for r in found.collect()) == [("a.md", "x" * 60, True), ("e.md", "é" * 60, True)]
    (tmp_path / "log.jsonl").write_text('{"ts": "2026-04-26T10:00:00", "tool": "s", "query": "q", "top_files": ["a"], "latency_ms": 5}\n\nnot json\n{"ts": "bad", "tool": "t"}\n')
    assert [r.tool for r in tables.query_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["s"]


def test_logs(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("b", 7.0)], "g string, v double")
    assert rows(L.rank_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95})) == [("a", 11.0, 20.0), ("b", 7.0, 7.0)]
    logs = spark.createDataFrame([("mode=all max_files=1500\nsuccess: 32 skip: 1468 chunks=17712\nRSS 10 RSS 55 RSS 20\nERROR a\nERROR b\nexit code: 0",), ("",)], "text string")
    r, empty = L.parsed_runs(logs).collect()
    assert (r.mode, r.max_files, r.success, r.skipped, r.chunks, r.exit_code, r.n_errors, r.rss_peak) == ("all", "1500", "32", "1468", "17712", "0", 2, 55)
    assert empty.mode is None and empty.n_errors == 0 and empty.rss_peak is None


def test_evaluation(spark):
    arrays = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(
        E.recall(arrays("a.md", "b.md"), arrays("/x/a.md", "/y/c.md")).alias("half"), E.recall(arrays("z"), arrays("/x/a.md")).alias("none"),
        E.chunk_hit(F.lit("NEEDLE"), arrays("has needle")).alias("hit"), E.facts_passed(F.lit("Alpha beta"), arrays("alpha", "gamma")).alias("facts"),
    ).first()
    assert tuple(r) == (0.5, 0.0, True, True)
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, passage[:-1]), (3, passage)], "doc_id long, text string")
    assert rows(E.passages_found(spark.createDataFrame([(1, passage), (2, "short one")], "item_id long, text string"), docs)) == [(1, 2), (2, 0)]


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    for sql in ("SELECT id AS create_time FROM numbers", "WITH a AS (SELECT * FROM numbers) SELECT count(*) FROM a", "SHOW TABLES", "DESCRIBE numbers", "EXPLAIN SELECT 1", "SELECT * FROM numbers WHERE id IN (SELECT 1 UNION SELECT 2)"):
        G.check(spark, sql)
    for sql in ("DROP TABLE numbers", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET a=1", "SELECT 1; DROP TABLE t", "EXPLAIN DROP TABLE numbers", "DELETE FROM numbers", "CACHE TABLE numbers", "nonsense", "SELECT " + "1+" * 5000 + "1"):
        with pytest.raises(G.Refused):
            G.check(spark, sql)
    assert G.run(spark, "SELECT * FROM numbers", most=3).count() == 3
    fixed = G.run_repaired(spark, "SELECT nope FROM numbers", lambda sql, columns: sql.replace("nope", columns["numbers"][0]))
    assert fixed.count() == 5
    assert G.qualified("SELECT * FROM a JOIN dm.b ON x", {"a": "db1", "b": "db2"}, {"dm": "data"}) == "SELECT * FROM db1.a JOIN data.b ON x"


@pytest.mark.parametrize("brackets", [2, 64])
def test_rank_percentiles_with_ties_nulls_and_a_hot_value(spark, brackets):
    r = random.Random(3)
    rows = [(g, v) for g in ("a", "b", None) for v in [5.0] * 70 + [r.choice((r.random() * 10, float(r.randrange(9)))) for _ in range(140)]]
    rows += [("one", 1.5), ("nulls", None), ("a", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: tuple(x[k] for k in shares) for x in L.rank_percentiles(df, ["g"], "v", shares, brackets).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        vs = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = tuple(vs[min(int(len(vs) * s), len(vs) - 1)] for s in shares.values())
    assert got == want


def test_sessions_and_trailing_counts_of_a_busy_client(spark):
    r = random.Random(5)
    seconds = sorted([r.randrange(30) * 3600 + r.choice((-1, 0, 1)) + 3600 for _ in range(150)] + [r.randrange(90_000) for _ in range(60)] + [7200] * 20)
    events = [(k, 1, t) for k, t in enumerate(seconds)] + [(1000 + k, 2, t) for k, t in enumerate((0, 3600, 7201, 7202))] + [(2000, None, 5), (2001, 3, None), (2002, 3, None)]
    df = spark.createDataFrame(events, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, last = {}, {}
    for _, u, t in sorted((e for e in events if e[2] is not None), key=lambda e: (str(e[1]), e[2], e[0])):
        if u not in last or t - last[u] > 3600:
            want.setdefault(u, []).append([0, t, t])
        want[u][-1][0] += 1
        want[u][-1][2] = last[u] = t
    got = {}
    for x in L.sessions(df).orderBy("session").collect():
        got.setdefault(x.user_id, []).append([x.n_events, x.first_ts and int(x.first_ts.timestamp()), x.last_ts and int(x.last_ts.timestamp())])
    assert got.pop(3) == [[1, None, None]] * 2
    assert got == want
    counts = {x.event_id: x.n for x in L.trailing_count(df, "user_id", "ts", "n", seconds=60, stretches=2).collect()}
    assert counts == {k: sum(v == u and ((s is None and t is None) or (s is not None and t is not None and t - 60 < s <= t)) for _, v, s in events) for k, u, t in events}
