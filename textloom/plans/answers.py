"""Queries: contexts, extracts, two-stage ranking, reports, code structure and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import answers as A
from textloom.operators import index as I
from textloom.operators import parsers as P
from textloom.operators import search as S
from textloom.plans.base import ORACLES, QUERIES, TOKENS, query
from textloom.plans.retrieval import query_vector
from textloom.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""WITH h AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(text, 'pathetic') QUALIFY rank <= 5)
 SELECT md5(string_agg('[文档' || rank || '] ' || left(text, 1500), chr(10) || chr(10) ORDER BY rank)) AS digest, list(doc_id ORDER BY rank)[1:3] AS sources FROM h""")
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.ranked(_docs(spark, sf_dir).where(F.col("text").contains("pathetic")), "n_chars", "doc_id", 5)
    return A.context(hits).select(F.md5("context").alias("digest"), "sources")


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: length(l) > 5 AND contains(lower(l), 'pathetic'))[1:3] AS lines FROM documents WHERE contains(lower(text), 'pathetic')")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.lower("text").contains("pathetic")).select("doc_id", A.extract("text", "pathetic").alias("lines"))


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = %d))"


@query(f"WITH f AS (SELECT vec_id FROM embeddings ORDER BY round({_COS % 0}, 6) DESC, vec_id LIMIT 20) SELECT vec_id, round({_COS % 1}, 6) AS score FROM embeddings SEMI JOIN f USING (vec_id) ORDER BY 2 DESC, 1 LIMIT 10")
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.two_stage(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir, 0), 10, query_vector(spark, sf_dir, 1))


@query(f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM p JOIN d USING (term)),
 n AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w)
 SELECT doc_id, term, weight FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5""")
def tf_idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = I.build(_docs(spark, sf_dir), X.tokens("text"))
    return A.tf_idf(index.postings, index.terms, index.corpus)


def _weights(events: DataFrame) -> DataFrame:
    spec = F.concat(F.lit("view="), F.floor("value").cast("string"), F.lit(",bad=x,extra="), F.col("event_id").cast("string"))
    rows = events.select("user_id", spec.alias("spec"))
    w = A.weights("spec", {"view": 0.5, "chunks": 0.4})
    return rows.select("user_id", "spec", w["view"].alias("view"), w["chunks"].alias("chunks"), F.try_element_at(w, F.lit("extra")).alias("extra"))


@query("""WITH e AS (SELECT user_id, 'view=' || CAST(floor(value) AS BIGINT) || ',bad=x,extra=' || event_id AS spec FROM events)
 SELECT user_id, spec, CAST(regexp_extract(spec, 'view=([0-9]+)', 1) AS DOUBLE) AS view, 0.4::DOUBLE AS chunks, CAST(regexp_extract(spec, 'extra=([0-9]+)', 1) AS DOUBLE) AS extra FROM e""")
def weights_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(table(spark, sf_dir, "events"))


QUERIES["weights_parse_all"], ORACLES["weights_parse_all"] = weights_parse, ORACLES["weights_parse"]  # its name while weights_parse read a part


@query("SELECT event_id, '***' AS token, CAST(user_id AS VARCHAR) AS client, CAST(2 AS BIGINT) AS n_allowed FROM events")
def audit_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("Token"), F.col("props"), F.lit("client"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", A.redacted(values).alias("m"))
    return rows.select("event_id", F.col("m")["Token"].alias("token"), F.col("m")["client"].alias("client"), F.size(A.allowed("m", ["client", "kind"])).cast("long").alias("n_allowed"))


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS o, list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n FROM events GROUP BY 1)
 SELECT user_id, coalesce(list_sort(list_filter(n, lambda x: NOT list_contains(coalesce(o, []), x))), []) AS added, coalesce(list_sort(list_filter(o, lambda x: NOT list_contains(coalesce(n, []), x))), []) AS removed FROM a""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of event each user took up and gave up."""
    return _taken_up(table(spark, sf_dir, "events"))


QUERIES["version_compare_all"], ORACLES["version_compare_all"] = version_compare, ORACLES["version_compare"]


def _taken_up(events: DataFrame) -> DataFrame:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    sets = events.groupBy("user_id").agg(F.collect_set(F.when(F.col("ts") < cut, F.col("event_type"))).alias("o"), F.collect_set(F.when(F.col("ts") >= cut, F.col("event_type"))).alias("n"))
    diff = A.compared(F.col("o"), F.col("n"))
    return sets.select("user_id", diff["added"].alias("added"), diff["removed"].alias("removed"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 30) AS succeeded, round(avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 6) AS avg_seconds, bool_and(value < 30) AS all_ok FROM events GROUP BY 1")
def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.processing_report(table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 30, F.col("value"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*(?:def |class |function |func |public |private |#|//|--|CREATE )'))[1:30] AS l, text FROM documents)
 SELECT doc_id, md5(CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: left(x, 100)), chr(10)) ELSE left(text, 500) END) AS digest FROM s""")
def code_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(P.signature_lines("text")).alias("digest"))


@query(r"""WITH r AS (SELECT p_brand AS sheet, p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part),
 t AS (SELECT *, k // 50 AS block, 'row ' || p_partkey || ': p_name=' || p_name || coalesce(', p_size=' || p_size, '') AS line FROM r)
 SELECT sheet, CAST(block AS INTEGER) AS block, md5(string_agg(line, chr(10) ORDER BY p_partkey)) AS digest, min(p_partkey) AS first_row, max(p_partkey) AS last_row, arg_min(p_name, p_partkey) AS primary_value FROM t GROUP BY sheet, block""")
def sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a sheet, in blocks of rows."""
    size = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), "p_partkey", "p_name", size.alias("p_size"))
    blocks = P.row_blocks(rows, ["p_name", "p_size"], order="p_partkey")
    return blocks.select("sheet", "block", F.md5("chunk").alias("digest"), "first_row", "last_row", "primary_value")


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: NOT (regexp_matches(l, '^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$') AND contains(l, '|'))) AS l FROM documents)
 SELECT doc_id, md5(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^\s*\|.*\|\s*$') THEN trim(regexp_replace(x, '\s*\|\s*', ' ', 'g')) ELSE x END), chr(10))) AS digest FROM l""")
def plain_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(P.plain_tables("text")).alias("digest"))
