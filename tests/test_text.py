from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
    return row.select(column.alias("r")).first().r


def test_tokens(spark):
    assert one(spark, X.tokens("t", ["the"]), t="The Cat-sat, a x1 É") == ["cat", "sat", "x1"]
    assert one(spark, X.mixed_tokens("t"), t="the 数据库abc wordword") == ["abc", "数", "据", "库", "wordword"]
    assert one(spark, X.keywords("t"), t="The Big of house, a B") == ["Big", "house"]
    assert one(spark, X.count_tokens("t"), t=" a  b 数据 ") == 5


def test_sanitise(spark):
    text = "call 13812345678 or a.b@c.org, id 11010519491231002X card 6222021234567890123"
    assert one(spark, X.sanitise("t", "none"), t=text) == text
    assert one(spark, X.sanitise("t"), t=text) == "call *** or ***, id 11010519491231002X card 6222021234567890123"
    assert one(spark, X.sanitise("t", "strict"), t=text) == "call *** or ***, id *** card ***"


def test_markup(spark):
    assert one(spark, X.plain_markdown("t"), t="# Head\n**b** *i* ~~s~~ [l](u) `c` <b>x</b>\n\n\n\nend ") == "Head\nb i s l c x\n\nend"
    assert one(spark, X.plain_html("t"), t="<p>a</p><script>x<1</script> <b>c</b>") == "a c"


def test_previews(spark):
    assert one(spark, X.preview("t", 3), t="abcd") == "abc..." and one(spark, X.preview("t", 4), t="abcd") == "abcd"
    assert one(spark, X.summary_preview("t"), t="文件:a\n摘要:短的。关键术语: x\n---\n原文") == "短的"
    assert one(spark, X.summary_preview("t"), t="plain body") == "plain body"
    body = "x" * 100 + "needle" + "y" * 300
    assert one(spark, X.snippet("t", "Needle"), t=body) == "..." + body[50:206] + "..."
    long = one(spark, X.smart_extract("t", 1000), t="a" * 700 + "b" * 5000 + "c" * 220)
    assert long.startswith("a" * 700) and long.endswith("c" * 220) and "[truncated 5000 chars]" in long


def test_paths(spark):
    for path, out in {"/a/node_modules/x.js": True, "/a/lib/python3.11/os.py": True, "/a/notes/x.md": False, "/a/x.bak.1": True, "/a/distance/x": False}.items():
        assert one(spark, X.is_excluded_path("p"), p=path) is out
    for path, out in {"/a/test_x.py": True, "/a/X_TEST.py": True, "/a/contest.py": False, "/a/test_x.md": False, "/a/read_headers.py": True}.items():
        assert one(spark, X.is_low_value_file("p"), p=path) is out
    for (d, t), out in {("_trash1", "a"): True, ("a", "x_bak"): True, ("a", "x_backup_20"): True, ("a", "orders"): False, (None, "gold"): False}.items():
        assert one(spark, X.is_excluded_table("d", "t"), d=d, t=t) is out
    assert [one(spark, X.dedup_key("p"), p=p) for p in ("/a/B.Tar.gz", "/x/.bashrc", "README")] == ["b.tar", ".bashrc", "readme"]
    assert one(spark, X.category("p"), p="/x/Daily_Report.md") == "news" and one(spark, X.category("p"), p="/x/y") == "其他"


def test_ids(spark):
    assert one(spark, X.chunk_id("f", F.lit(7)), f="ab") == "ab_chunk_007"
    hexes = "0" * 32
    cases = {("docs", hexes): False, ("docs", "note_1"): True, ("chunks", hexes + "_chunk_12"): False, ("chunks", hexes): True}
    for (kind, id), out in cases.items():
        assert one(spark, X.is_legacy_id("k", "i"), k=kind, i=id) is out
    assert one(spark, X.content_fingerprint("p", "t"), p="a", t=" x\n") == one(spark, X.content_fingerprint("p", "t"), p="a", t="x")


def test_answers(spark):
    assert one(spark, X.groundedness("a", "c"), a="alpha beta [文档1]", c="alpha beta gamma 文档1") == 1.0
    assert abs(one(spark, X.groundedness("a", "c"), a="alpha delta", c="alpha beta") - 0.4) < 1e-9
    assert one(spark, X.answer_issues("a", F.lit(0.1)), a=" ") == ["empty", "low_groundedness", "no_citation"]
    assert one(spark, X.referenced_tables("s"), s="select * from db.a join B on x from a") == ["a", "B"]
    assert one(spark, X.sql_without_comments("s"), s="a -- x\nb /* y\n */ c") == "a \nb  c"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    r = df.select(
        V.cosine("a", "b").alias("c"), V.cosine("a", "z").alias("rz"), V.cosine("a", "s").alias("rs"), V.euclidean("a", "b").alias("d"), V.euclidean("a", "s").alias("i"), V.normalise("a").alias("n"),
        V.normalise("z").alias("nz"), V.padded("s", 3).alias("p"), V.is_valid("a").alias("ok"), V.is_valid(F.array(F.lit(float("nan")))).alias("no"),
    ).first()
    assert abs(r.c - 0.96) < 1e-12 and r.rz == 0 and r.rs == 0 and abs(r.d - 2**0.5) < 1e-12 and r.i == float("inf")
    assert r.n == [0.6, 0.8] and r.nz == [0.0, 0.0] and r.p == [1.0, 0.0, 0.0] and r.ok and not r.no
    maps = spark.range(1).select(*[V.similarity(F.lit(float(d)), k).alias(f"{k}{d}") for k in ("half", "one", "inverse") for d in (0, 1, 2)]).first()
    assert list(maps) == [1.0, 0.5, 0.0, 1.0, 0.0, -1.0, 1.0, 0.5, 1 / 3]
