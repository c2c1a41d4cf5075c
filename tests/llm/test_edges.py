"""Every operator and stage on tables with clashing columns, repeated rows, null ids, null and empty texts, and no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, embed_dedup, exact_dedup, langid, negatives, packing, pii, quality, resample, simhash, substring, toxicity, warc

#: Names that the operators use inside.
NAMES = ["__row", "__spans", "__blocks", "row", "uid", "kept", "held_out", "text_sha256", "spans", "code", "place", "label", "value", "words", "size", "digest", "page_id", "html", "url", "vector", "h"]
LONG = "word " * 30_000
TEXTS = [None, "", " \n", "The house and the garden of an old friend", "The house and the garden of an old friend", "mail me at a@b.org or +1 (555) 123-4567", LONG, "été à la maison et dans le jardin", "😀"]
ROWS = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5])] * 2


def table(spark, tmp_path, rows=ROWS, name="docs"):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    docs = docs.withColumns({n: F.lit(n) for n in NAMES})
    docs.repartition(2).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int").withColumn("quality", F.col("toxic")).withColumn("text", F.lit("clash")).withColumn("label", F.lit("clash"))


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "simhash": simhash.near_dedup,
    "substring": substring.remove_repeats,
    "toxicity": lambda docs: toxicity.score_documents(docs, labels(docs.sparkSession)),
    "bpe": lambda docs: bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")),
    "pii": pii.find,
    "packing": lambda docs: packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")),
    "langid": langid.identify,
    "resample": lambda docs: resample.resample(docs, docs),
    "quality": lambda docs: quality.score_documents(docs, labels(docs.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, tmp_path, name):
    ids = sorted((r.doc_id for r in OPERATORS[name](table(spark, tmp_path)).collect()), key=str)
    wanted = sorted((i for i, _ in ROWS), key=str)
    assert (sorted(set(ids), key=str) == sorted(set(wanted), key=str)) if name == "packing" else ids == wanted
    assert OPERATORS[name](table(spark, tmp_path, [], "none")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, tmp_path, name, stage):
    docs = table(spark, tmp_path)
    out = stage(spark, docs, None)
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(r[n] == n for r in kept for n in NAMES)
    counted = {"language_id": lambda n: 0 < n <= 11, "exact_dedup": lambda n: n == 6, "simhash_near_dedup": lambda n: 0 < n <= 6, "pii": lambda n: n == 11}
    assert counted[name](len(kept))
    empty = stage(spark, table(spark, tmp_path, [], "none"), None)
    assert empty.columns == docs.columns and empty.count() == 0


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a/é", "x" * 200), (1, "http://a/é", "x" * 200), (2, "b", "x" * 200), (3, None, ""), (None, "c", "y" * 3_000_000)], "page_id long, url string, html string")
    pages = pages.withColumns({n: F.lit(n) for n in ("row", "digest", "size", "refers_to", "payload")})
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_report(pages).collect()), key=str)
    wanted = [(None, 0, "response", None), (1, 200, "response", None), (1, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 0, "response", None), (None, 3_000_000, "response", None)]
    assert got == sorted(wanted, key=str)
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [0.0, 1.0], None)], "vec_id long, embedding array<float>, label int")
    rows = rows.withColumns({n: F.lit(n) for n in ("row", "vector", "rep", "n", "bits", "cell")})
    assert sorted((r.n_links, r.kept) for r in embed_dedup.near_vectors(rows).collect()) == [(0, True), (1, True), (1, True)]
    assert negatives.hard_negatives(rows, every=1).count() == 0
