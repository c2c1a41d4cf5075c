"""Queries: splitting runs of letters into words, and learning words from runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import segment as Seg
from textloom.plans.base import query
from textloom.sources.tables import table

LETTERS = r"\p{L}+"
_RUNS = r"runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS run FROM documents) GROUP BY run)"


@query(f"""WITH RECURSIVE {_RUNS}, dict AS (
  SELECT run AS word, n, sum(n) OVER () AS t FROM runs WHERE length(run) <= 6 AND n >= 3
), price AS (
  SELECT word, CAST(floor(1000 * ln(t / n)) AS BIGINT) AS cost FROM dict
), unknown AS (
  SELECT CAST(floor(1000 * ln(max(t)::DOUBLE)) AS BIGINT) + 1000 AS u FROM dict
), ends AS (
  SELECT run, unnest(range(1, length(run) + 1)) AS e FROM runs
), cut AS (
  SELECT run, e, unnest(range(1, least(e, 6) + 1)) AS s FROM ends
), met AS (
  SELECT run, e, s, cost FROM cut JOIN price ON word = substr(run, e - s + 1, s)
), ways AS (
  SELECT run, e, list({{'s': s, 'c': c}}) AS ways FROM (
    SELECT run, e, s, cost AS c FROM met UNION ALL SELECT run, e, 1, u FROM ends, unknown WHERE (run, e) NOT IN (SELECT (run, e) FROM met WHERE s = 1)
  ) GROUP BY run, e
), best AS (
  SELECT run, 0 AS i, [0::BIGINT] AS costs, [0::BIGINT] AS backs FROM runs
  UNION ALL
  SELECT run, i + 1, list_append(costs, b.c), list_append(backs, -b.s) FROM (
    SELECT best.run, i, costs, backs, list_min(list_transform(ways.ways, lambda w: {{'c': costs[i + 2 - w.s] + w.c, 's': -w.s}})) AS b FROM best JOIN ways ON ways.run = best.run AND ways.e = i + 1)
), split AS (
  SELECT run, backs, length(run) AS e, []::VARCHAR[] AS pieces FROM best WHERE i = length(run)
  UNION ALL
  SELECT run, backs, e - backs[e + 1], list_prepend(substr(run, e - backs[e + 1] + 1, backs[e + 1]), pieces) FROM split WHERE e > 0
)
SELECT run, n, array_to_string(pieces, '|') AS pieces FROM split JOIN runs USING (run) WHERE e = 0""")
def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the documents, split by the short words among them."""
    runs = Seg.run_counts(table(spark, sf_dir, "documents"), LETTERS)
    dictionary = runs.where((F.length("run") <= 6) & (F.col("n") >= 3)).select(F.col("run").alias("word"), "n")
    split = Seg.split_runs(runs, Seg.costs(dictionary))
    return split.join(runs, "run").select("run", "n", F.array_join("pieces", "|").alias("pieces"))


@query(f"""WITH {_RUNS}, spots AS (
  SELECT run, n, unnest(range(1, length(run) + 1)) AS a FROM runs
), grams AS (
  SELECT substr(run, a, s) AS word, CASE WHEN a > 1 THEN substr(run, a - 1, 1) ELSE '' END AS l, substr(run, a + s, 1) AS r, n
  FROM (SELECT run, n, a, unnest(range(1, least(4, length(run) - a + 1) + 1)) AS s FROM spots)
), counts AS (
  SELECT word, sum(n) AS n FROM grams GROUP BY word
), often AS (
  SELECT word, n, unnest(range(1, length(word))) AS k FROM counts WHERE length(word) > 1 AND n >= 20
), held AS (
  SELECT o.word, o.n FROM often o JOIN counts a ON a.word = substr(o.word, 1, k) JOIN counts b ON b.word = substr(o.word, k + 1)
  GROUP BY 1, 2 HAVING min(o.n * (SELECT sum(n) FROM counts WHERE length(word) = 1) / (a.n * b.n)) >= 6
), l AS (
  SELECT word FROM (SELECT word, l, sum(grams.n) / any_value(held.n) AS p FROM grams JOIN held USING (word) GROUP BY word, l) GROUP BY word HAVING sum(-p * ln(p)) >= 1.2
), r AS (
  SELECT word FROM (SELECT word, r, sum(grams.n) / any_value(held.n) AS p FROM grams JOIN held USING (word) GROUP BY word, r) GROUP BY word HAVING sum(-p * ln(p)) >= 1.2
)
SELECT word, CAST(n AS BIGINT) AS n FROM held WHERE word IN (SELECT word FROM l) AND word IN (SELECT word FROM r)""")
def learned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of two to four letters that recur as units inside the documents' words."""
    runs = Seg.run_counts(table(spark, sf_dir, "documents"), LETTERS)
    return Seg.learned_words(runs, longest=4, least=20, cohesion=6.0, freedom=1.2)
