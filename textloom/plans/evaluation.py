"""Queries: retrieval evaluation over benchmark passages, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions import text as X
from textloom.operators import evaluate as E
from textloom.operators import index as I
from textloom.plans.base import TOKENS, query
from textloom.plans.retrieval import _MANY, _STOP, _TOP, gram_index, stored_index
from textloom.sources.tables import table


@query("SELECT item_id, (SELECT count(*) FROM documents d WHERE contains(d.text, o.text)) AS n_docs FROM benchmark o")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each passage stands, by the passages' rarest grams."""
    passages = table(spark, sf_dir, "benchmark")
    held = gram_index(spark, sf_dir).held(passages, table(spark, sf_dir, "documents"))
    return passages.select("item_id").join(held.groupBy("item_id").agg(F.count("*").alias("n_docs")), "item_id", "left").fillna(0, ["n_docs"])


_ASKED = f"""{_MANY}), q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter({TOKENS}, lambda x: NOT list_contains({_STOP}, x))) AS term FROM benchmark) GROUP BY ALL
), {_TOP}, x AS (SELECT query_id, count(*) FILTER (WHERE contains(d.text, b.text)) AS held, bool_or(contains(lower(d.text), lower(b.text))) AS hit FROM h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 GROUP BY 1
)"""


def _asked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(item_id, held, hit): how many of the k documents that BM25 finds for a benchmark passage hold it, and whether any does in any case. Texts
    are tested whole, document by document, and the tests are summed up."""
    items = table(spark, sf_dir, "benchmark")
    terms = items.select(F.col("item_id").alias("query_id"), F.explode(X.tokens("text", fixed.INDEX_STOPWORDS)).alias("term"))
    hits = I.score_many(stored_index(spark, sf_dir).read(), terms.groupBy("query_id", "term").agg(F.count("*").alias("times")), k)
    read = hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "query_id")
    held, hit = F.contains("text", F.col("passage")), F.contains(F.lower("text"), F.lower("passage"))
    return read.groupBy(F.col("query_id").alias("item_id")).agg(F.sum(held.cast("long")).alias("held"), F.bool_or(hit).alias("hit"))


@query(f"{_ASKED}, n AS (SELECT item_id, (SELECT count(*) FROM documents d WHERE contains(d.text, o.text)) AS n_docs FROM benchmark o) SELECT item_id, round(coalesce(held, 0) / least(n_docs, 10)::DOUBLE, 6) AS recall FROM n LEFT JOIN x ON query_id = item_id WHERE n_docs > 0")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that hold a passage (ten at most), the share among the ten best hits for it."""
    wanted = E.passages_found(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).where("n_docs > 0")
    return wanted.join(_asked(spark, sf_dir), "item_id", "left").select("item_id", F.round(F.coalesce("held", F.lit(0)) / F.least("n_docs", F.lit(10)), 6).alias("recall"))


@query(f"{_ASKED} SELECT item_id, coalesce(hit, false) AS hit FROM benchmark LEFT JOIN x ON query_id = item_id")
def chunk_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any of the ten best hits for a passage holds it."""
    return table(spark, sf_dir, "benchmark").select("item_id").join(_asked(spark, sf_dir), "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT conv_id, turn, len(list_filter(['the', 'le', 'der', 'zzz'], lambda f: contains(lower(text), f))) >= 2 AS passed FROM conversations")
def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.array(*map(F.lit, ("the", "le", "der", "zzz")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.facts_passed(F.col("text"), facts).alias("passed"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), w AS (
 SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS said, list_filter(string_split_regex(lower(coalesce(context, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3) AS known FROM c)
 SELECT conv_id, turn, round(least(1.0, 0.8 * len(list_filter(said, lambda x: list_contains(known, x))) / greatest(len(said), 1)), 6) AS grounded FROM w""")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each turn the turn before it grounds."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    turns = table(spark, sf_dir, "conversations").withColumn("context", before)
    return turns.select("conv_id", "turn", F.round(X.groundedness("text", "context"), 6).alias("grounded"))


@query("""WITH e AS (SELECT l.doc_id, d.lang, l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS long, CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END AS clean FROM labels l JOIN documents d USING (doc_id))
 SELECT lang, round(avg(CASE WHEN long = quality THEN 1.0 ELSE 0.0 END), 6) AS by_length, round(avg(CASE WHEN clean = quality THEN 1.0 ELSE 0.0 END), 6) AS by_clean, round(avg(CASE WHEN clean = quality THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN long = quality THEN 1.0 ELSE 0.0 END), 6) AS gain FROM e GROUP BY 1""")
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to guess quality, side by side and their difference."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    long = (F.col("n_chars") > 1000).cast("int") == F.col("quality")
    clean = (F.col("toxic") == 0).cast("int") == F.col("quality")
    return both.groupBy("lang").agg(F.avg(long.cast("double")).alias("a"), F.avg(clean.cast("double")).alias("b")).select("lang", F.round("a", 6).alias("by_length"), F.round("b", 6).alias("by_clean"), F.round(F.col("b") - F.col("a"), 6).alias("gain"))
