"""The registered queries of this package, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("uid")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.embed_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.simhash import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.warc import archive_report

    return archive_report(_table(spark, sf_dir, "pages"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", moved, "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_embedding_near_dedup,
        op3_simhash_near_dedup,
        op4_substring_dedup,
        op5_toxicity,
        op6_warc_archive,
        op7_bpe_round_trip,
        op8_pii,
        op9_packing,
        op10_language_id,
        op11_importance_resampling,
        op12_quality,
        op13_hard_negatives,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rk, count(*) OVER (PARTITION BY norm) AS n
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, rk = 1 AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op2_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), c AS (
  SELECT a, min(b) AS c FROM r GROUP BY a
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT s.r, i, md5(array_to_string(d.w[i:i + 34], ' ')) AS k FROM s JOIN d USING (r)
), rep AS (
  SELECT r, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p WHERE gone.r IS NULL GROUP BY 1
), n AS (
  SELECT r, count(*) AS n FROM gone GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
""",
    "op6_warc_archive": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS rk
  FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id ASC NULLS LAST)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN n >= 100 AND rk > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND rk > 1 THEN first_id END AS refers_to
FROM g
""",
    "op11_importance_resampling": r"""
WITH crc AS (
  SELECT list(x ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS x FROM range(256) r(k))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS w FROM d
), words AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
                                        lambda c, x: xor(c >> 8, crc.t[xor(c & 255, x) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM b), crc
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN words USING (w) GROUP BY 1
), t AS (
  SELECT bucket, count(*) AS n FROM b JOIN words USING (w) GROUP BY 1
), gain AS (
  SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g
  FROM range(10000) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket
), weight AS (
  SELECT doc_id, sum(g) AS weight FROM dw JOIN words USING (w) JOIN gain USING (bucket) GROUP BY 1
), scored AS (
  SELECT d.doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)
QUALIFY row_number() OVER w <= 10
""",
}
