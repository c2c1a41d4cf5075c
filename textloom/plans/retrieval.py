"""Queries: BM25, nearest neighbours by words, fusion, keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions import text as X
from textloom.operators import grams as G
from textloom.operators import index as I
from textloom.operators import search as S
from textloom.plans.base import ORACLES, QUERIES, TOKENS, query, sql_list, stored
from textloom.shared import new_folder
from textloom.sources.tables import table

#: The query of the retrieval queries; a repeated word counts twice.
WORDS = ["worthless", "tion", "inea", "the", "erin", "inea"]
K = 10

_STOP = sql_list(fixed.INDEX_STOPWORDS)
_BM25 = f"""
WITH t AS (
  SELECT doc_id, list_filter({TOKENS}, lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents
), l AS (
  SELECT doc_id, len(w) AS dl FROM t
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL
), c AS (
  SELECT count(*) AS n, avg(dl) AS avgdl FROM l
), d AS (
  SELECT term, count(*) AS df FROM p GROUP BY term
), i AS (
  SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, c
), f AS (
  SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS floored, raw FROM i
), q AS (
  SELECT term, count(*) AS times FROM (SELECT unnest({sql_list(WORDS)}) AS term) GROUP BY term
), s AS (
  SELECT doc_id, sum(times * floored * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score,
         sum(times * raw * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw_score
  FROM p JOIN f USING (term) JOIN q USING (term) JOIN l USING (doc_id), c GROUP BY doc_id
), b AS (
  SELECT doc_id, round(score, 6) AS score FROM s WHERE round(score, 6) > 0
)"""


def stored_index(spark: SparkSession, sf_dir: str) -> I.StoredIndex:
    """The stored index of the documents, built by the first query of a session that needs it."""

    def build(folder: str, docs: DataFrame) -> I.StoredIndex:
        index = I.StoredIndex(spark, folder)
        index.upsert(docs, X.tokens("text", fixed.INDEX_STOPWORDS))
        return index

    return stored(spark, sf_dir, "documents", "bm25", build)


def gram_index(spark: SparkSession, sf_dir: str) -> G.GramIndex:
    """The stored gram index of the documents."""
    return stored(spark, sf_dir, "documents", "grams", lambda folder, docs: G.GramIndex(spark, folder).add(docs))


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    return stored_index(spark, sf_dir).read()


def _word_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return S.ranked(stored_index(spark, sf_dir).search(WORDS, k, least=0), "score", "doc_id", k)


@query(f"{_BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_hits(spark, sf_dir, K).select("doc_id", "score")


@query(f"{_BM25} SELECT doc_id, round(raw_score, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT {K}")
def bm25_raw_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).search(WORDS, K, floor=False)


@query(f"{_BM25} SELECT doc_id, score FROM b JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') AND n_chars >= 500 ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = docs.where(S.matches({"lang": ["en", "de"], "n_chars": {"$gte": 500}}))
    return stored_index(spark, sf_dir).search(WORDS, K, where=chosen, least=0)


@query(f"{_BM25}, r AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 1) SELECT * FROM r")
def bm25_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document alone: most groups of documents lie below its score and stay unread."""
    return stored_index(spark, sf_dir).search(WORDS, 1, least=0)


@query(f"{_BM25} SELECT (SELECT count(*) FROM l) AS n_docs, (SELECT round(avg(dl), 6) FROM l) AS avg_len, (SELECT min(dl) FROM l) AS min_len, (SELECT max(dl) FROM l) AS max_len, (SELECT count(*) FROM d) AS vocabulary")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.statistics(_index(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


def _changed(spark: SparkSession, sf_dir: str) -> I.StoredIndex:
    """An index of all documents, a part of which is put in anew, longer, and another part taken out."""
    docs, tokens = table(spark, sf_dir, "documents"), X.tokens("text", fixed.INDEX_STOPWORDS)
    index = I.StoredIndex(spark, new_folder(spark, "bm25"))
    index.upsert(docs, tokens)
    index.upsert(docs.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" worthless tion"))), tokens)
    index.remove(docs.where("lang = 'fr'").select("doc_id"))
    return index


_NOW = _BM25.replace("FROM documents\n", "FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' worthless tion' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr')\n")


@query(f"{_NOW} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after updates and removals are those of an index built anew."""
    return _changed(spark, sf_dir).search(WORDS, K, least=0)


@query(f"{_NOW} SELECT term, df FROM d")
def bm25_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after updates and removals, and after the segments are merged into one."""
    index = _changed(spark, sf_dir)
    index.compact()
    return index.read().terms


_MANY = _BM25[: _BM25.index("), q AS (")]
_TOP = f"""g AS (SELECT query_id, p.doc_id, round(sum(times * floored * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM p JOIN f USING (term) JOIN q USING (term) JOIN l ON l.doc_id = p.doc_id, c GROUP BY 1, 2
), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0)"""
_LIKE = f"""{_MANY}), q AS (SELECT doc_id AS query_id, term, 1 AS times FROM p WHERE doc_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) <= 10
), {_TOP}"""


def _like_these(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): every hundredth document, by its ten most frequent terms, against all documents."""
    index = _index(spark, sf_dir)
    asked = S.best_per_key(index.postings.where("doc_id % 100 = 0"), "doc_id", [F.col("tf").desc(), F.col("term")], 10)
    return I.score_many(index, asked.select(F.col("doc_id").alias("query_id"), "term", F.lit(1).alias("times")), k)


@query(f"{_LIKE} SELECT query_id, doc_id, score FROM h WHERE rank <= {K}")
def bm25_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _like_these(spark, sf_dir, K).drop("rank")


@query(f"""{_LIKE}, w AS (SELECT * FROM h WHERE rank <= 20),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
 m AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + w.rank), 0), 6) AS rrf_score FROM v FULL JOIN w USING (query_id, doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS k FROM m) SELECT query_id, doc_id, rrf_score FROM r WHERE k <= {K}""")
def hybrid_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors of every hundredth row against all rows, fused by reciprocal ranks."""
    vectors = table(spark, sf_dir, "embeddings")
    near = S.ranked_per_query(S.nearest_of_many(vectors.where("vec_id % 100 = 0"), vectors, 20, group=None).withColumnRenamed("vec_id", "doc_id"), 20)
    words = _like_these(spark, sf_dir, 20)
    both = near.select("query_id", "doc_id", F.col("rank").alias("v")).join(words.select("query_id", "doc_id", F.col("rank").alias("w")), ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (60 + F.col(c)), F.lit(0.0))
    fused = both.select("query_id", "doc_id", F.round(part("v") + part("w"), 6).alias("rrf_score"))
    return S.best_per_key(fused, "query_id", [F.col("rrf_score").desc(), F.col("doc_id")], K)


@query(f"{_BM25}, r AS (SELECT b.*, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM b JOIN documents USING (doc_id)) SELECT source, doc_id, score FROM r WHERE k = 1 ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = I.score(_index(spark, sf_dir), WORDS).select("doc_id", F.round("score", 6).alias("score")).where("score > 0")
    named = scored.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    best = S.best_per_key(named, "source", [F.col("score").desc(), F.col("doc_id")])
    return S.top(best.select("source", "doc_id", "score"), "score", "doc_id", K)


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = I.build(table(spark, sf_dir, "documents"), X.tokens("text"))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


QUERIES["term_statistics_all"], ORACLES["term_statistics_all"] = term_statistics, ORACLES["term_statistics"]


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.tokens("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(rf"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1 AND NOT list_contains({sql_list(fixed.KEYWORD_STOPWORDS)}, lower(x)))) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.keywords("text")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


# --- fusion ----------------------------------------------------------------------------------------------------------------

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_HITS = f"""{_BM25}, v AS (
  SELECT vec_id AS doc_id, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})) / 2, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20
), vr AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM v
), w AS (
  SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20
), wr AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM w
), wn AS (
  SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS score FROM w
)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the query's."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def _vector_hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return S.ranked(S.nearest(vectors, query_vector(spark, sf_dir), k, key="doc_id", kind="half"), "score", "doc_id", k)


@query(f"""{_HITS} SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + vr.rk), 0) + coalesce(1.0::DOUBLE / (60 + wr.rk), 0), 6) AS rrf_score,
 CASE WHEN vr.rk IS NULL THEN 'bm25' WHEN wr.rk IS NULL THEN 'vector' ELSE 'both' END AS match_type
 FROM vr FULL JOIN wr USING (doc_id) ORDER BY 2 DESC, 1 LIMIT {K}""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: words and vectors, fused by reciprocal ranks."""
    return S.reciprocal_rank_fusion(_vector_hits(spark, sf_dir), _word_hits(spark, sf_dir, 20), "doc_id", K)


@query(f"{_HITS} SELECT doc_id, round(0.6 * coalesce(v.score, 0) + 0.4 * coalesce(wn.score, 0), 6) AS score FROM v FULL JOIN wn USING (doc_id) ORDER BY 2 DESC, 1 LIMIT {K}")
def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.min_max(_word_hits(spark, sf_dir, 20)).select("doc_id", F.col("normalised").alias("score"))
    return S.linear_fusion(_vector_hits(spark, sf_dir), words, "doc_id", K)


@query(f"{_HITS} SELECT doc_id, round(score, 6) AS normalised FROM wn")
def hybrid_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.min_max(_word_hits(spark, sf_dir, 20)).select("doc_id", F.round("normalised", 6).alias("normalised"))


_THIRD = "t3 AS (SELECT doc_id, 0.5::DOUBLE AS score FROM documents WHERE text LIKE '%pathetic%' ORDER BY doc_id LIMIT 20)"


@query(f"""{_HITS}, {_THIRD}, two AS (
  SELECT doc_id, coalesce((v.score + wn.score) / 2, v.score, wn.score) AS ab, v.score IS NOT NULL AS a, wn.score IS NOT NULL AS b FROM v FULL JOIN wn USING (doc_id)
) SELECT doc_id, round(CASE WHEN ab IS NULL THEN score WHEN score IS NULL THEN ab ELSE ab * 1.1 END, 6) AS score,
  array_to_string(list_filter([CASE WHEN a THEN 'vector' END, CASE WHEN b THEN 'bm25' END, CASE WHEN score IS NOT NULL THEN 'third' END], lambda x: x IS NOT NULL), '+') AS methods
  FROM two FULL JOIN t3 USING (doc_id) ORDER BY 2 DESC, 1 LIMIT {K}""")
def unified_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.min_max(_word_hits(spark, sf_dir, 20)).select("doc_id", F.col("normalised").alias("score"))
    third = table(spark, sf_dir, "documents").where(F.col("text").contains("pathetic")).orderBy("doc_id").limit(20).select("doc_id", F.lit(0.5).alias("score"))
    return S.merge_three(_vector_hits(spark, sf_dir), words, third, "doc_id", K)


@query(f"{_HITS} SELECT doc_id, score FROM v ORDER BY score DESC, doc_id LIMIT {K}")
def hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fused list of no hits falls back to the vectors' list."""
    vector, words = _vector_hits(spark, sf_dir).select("doc_id", "score"), _word_hits(spark, sf_dir, 20).select("doc_id", "score")
    return S.with_fallback(words.where("score < 0"), vector, words, "doc_id", K)


@query(f"""{_BM25}, h AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20)
 SELECT doc_id, round(len(list_intersect(['erin', 'inea', 'the', 'worthless'], list_filter(string_split_regex(lower(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 512)), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2))) / 4.0::DOUBLE, 6) AS rerank_score,
 row_number() OVER (ORDER BY rerank_score DESC, doc_id) AS rank FROM h JOIN documents USING (doc_id) ORDER BY rank LIMIT 5""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _word_hits(spark, sf_dir, 20).drop("rank").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.rerank(hits, "the erin inea worthless", 5).select("doc_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


# --- keyword search ----------------------------------------------------------------------------------------------------------

_LOOK = ["pathetic", "src1", "fr"]


@query(f"""WITH s AS (SELECT doc_id, round({" + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(source), '{w}') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(lang), '{w}') THEN 0.3 ELSE 0 END)::DOUBLE" for w in _LOOK)}, 6) AS raw FROM documents)
 SELECT doc_id, raw, round(least(raw / 3, 1.0), 6) AS similarity FROM s WHERE raw > 0 ORDER BY raw DESC, doc_id LIMIT 20""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keyword_search(gram_index(spark, sf_dir), table(spark, sf_dir, "documents"), _LOOK, 20)


_WHOLE = [w for w in _LOOK if w != "src1"]


@query(f"""WITH v AS (SELECT vec_id AS doc_id, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})) / 2, 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20),
 s AS (SELECT doc_id, round({" + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(source), '{w}') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(lang), '{w}') THEN 0.3 ELSE 0 END)::DOUBLE" for w in _WHOLE)}, 6) AS raw FROM documents),
 k AS (SELECT doc_id, round(least(raw / {len(_WHOLE)}, 1.0), 6) AS similarity FROM s WHERE raw > 0 ORDER BY raw DESC, doc_id LIMIT 20),
 b AS (SELECT doc_id, max(similarity) AS similarity FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY 1)
 SELECT doc_id, round(0.3 * (({" + ".join(f"CASE WHEN contains(lower(left(text, 200)), '{w}') THEN 1.0 ELSE 0.0 END" for w in _WHOLE)})::DOUBLE / {len(_WHOLE)}) + 0.7 * similarity, 6) AS score FROM documents JOIN b USING (doc_id) ORDER BY 2 DESC, 1 LIMIT {K}""")
def hybrid_keyword_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vector = _vector_hits(spark, sf_dir).select("doc_id", F.col("score").alias("similarity"))
    return S.keyword_vector_hybrid(docs, S.keyword_search(docs, _WHOLE, 20), vector, _WHOLE, K)


@query(f"""WITH s AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS n FROM s WHERE n > 0 ORDER BY n DESC, doc_id LIMIT {K}""")
def occurrence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", S.occurrences("text", "the").alias("n")).where("n > 0")
    return S.top(counted, "n", "doc_id", K)


@query(f"""WITH s AS (SELECT doc_id, round((CASE WHEN contains(lower(text), 'that the') THEN 1.0 WHEN contains(lower(source), 'that the') THEN 0.8 WHEN contains(lower(lang), 'that the') THEN 0.5 ELSE 0 END
 + CASE WHEN contains(lower(text), 'that') OR contains(lower(text), 'the') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0.5 ORDER BY score DESC, doc_id LIMIT {K}""")
def contains_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contains_rank(table(spark, sf_dir, "documents"), "that the", K)


_NEEDLES = ["pathetic", "THE ", "st. w", "ñ", "qz", "é", "erin thonea", "&&", "no such thing"]


@query("SELECT needle, count(*) AS n_docs, CAST(min(doc_id) AS BIGINT) AS first_id, CAST(max(doc_id) AS BIGINT) AS last_id FROM documents JOIN (SELECT unnest(" + sql_list(_NEEDLES) + ") AS needle) ON contains(lower(text), lower(needle)) GROUP BY needle")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each of some needles, long and short, in any case."""
    needles = spark.createDataFrame([(w, w) for w in _NEEDLES], "needle string, text string")
    held = gram_index(spark, sf_dir).held(needles, table(spark, sf_dir, "documents"), "needle", any_case=True)
    return held.groupBy("needle").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT doc_id, source, 1.0::DOUBLE AS score FROM documents WHERE source = 'src3'")
def search_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "source", F.lit(1.0).alias("score"))


@query("""WITH m AS (SELECT doc_id, text, left(text, 50) AS head FROM documents WHERE contains(lower(text), 'pathetic')), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY doc_id) AS k FROM m)
 SELECT doc_id, head FROM r WHERE k = 1 ORDER BY doc_id LIMIT 10""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = gram_index(spark, sf_dir).search("pathetic", table(spark, sf_dir, "documents")).select("doc_id", F.substring("text", 1, 50).alias("head"))
    return S.best_per_key(held, "head", [F.col("doc_id")]).orderBy("doc_id").limit(10)


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 300 AND n_chars <= 2000 AND source IN ('src1', 'src2', 'src3')")
def where_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(S.matches({"lang": "fr", "n_chars": {"$gt": 300, "$lte": 2000}, "source": ["src1", "src2", "src3"]})).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ') AND p_size = 5")
def fuzzy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(S.loosely_matches({"p_type": "ECON", "p_size": 5}, dict(part.dtypes))).select("p_partkey")
