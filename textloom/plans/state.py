"""Queries: incremental state over snapshots of documents, store statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import state as St
from textloom.plans.base import query
from textloom.shared import new_folder
from textloom.sources.snapshot import SnapshotTable
from textloom.sources.store import upserted, without
from textloom.sources.tables import table

# Snapshots of one corpus: the old one lacks each seventh document, the new one each fifth, and each eleventh was edited.
_SNAPSHOTS = """WITH o AS (SELECT doc_id AS path, md5(text) AS fp FROM documents WHERE doc_id % 7 <> 0),
 n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS fp FROM documents WHERE doc_id % 5 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("fp"))
    return old, docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.md5(edited).alias("fp"))


@query(f"{_SNAPSHOTS} SELECT path, fp FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.fp = n.fp)")
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return St.todo(new, old)


@query(f"{_SNAPSHOTS} SELECT path, CASE WHEN o.fp IS NULL THEN 'added' WHEN n.fp IS NULL THEN 'deleted' WHEN o.fp <> n.fp THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (path)")
def change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.changes(*_snapshots(spark, sf_dir))


@query(f"{_SNAPSHOTS} SELECT path, coalesce(n.fp, o.fp) AS fp FROM o FULL JOIN n USING (path)")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upserted(old, new, ["path"])


@query(f"{_SNAPSHOTS} SELECT path, fp FROM o WHERE path NOT IN (SELECT path FROM n)")
def delete_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return without(old, new, ["path"])


def _committed(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """The old snapshot, then the new one's documents put in, then every ninth path taken out: three commits."""
    old, new = _snapshots(spark, sf_dir)
    kept = SnapshotTable(spark, new_folder(spark, "snapshot"), ["path"])
    kept.append(old)
    kept.upsert(new)
    kept.delete(new.where("path % 9 = 0"))
    return kept


@query(f"{_SNAPSHOTS} SELECT path, coalesce(n.fp, o.fp) AS fp FROM o FULL JOIN n USING (path) WHERE n.fp IS NULL OR path % 9 <> 0")
def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).read()


@query(f"""{_SNAPSHOTS} SELECT 0 AS version, 'append' AS did, (SELECT count(*) FROM o) AS grown_by UNION ALL SELECT 1, 'upsert', (SELECT count(*) FROM n WHERE path NOT IN (SELECT path FROM o))
 UNION ALL SELECT 2, 'delete', -(SELECT count(*) FROM n WHERE path % 9 = 0)""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit log: what each version did and by how many rows the table grew."""
    rows = [(h["version"], h["did"], h["rows_added"] - h["rows_removed"]) for h in _committed(spark, sf_dir).history()]
    return spark.createDataFrame(rows, "version int, did string, grown_by long")


@query(f"{_SNAPSHOTS} SELECT path, fp FROM o WHERE path % 2 = 0")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier version, after later commits."""
    return _committed(spark, sf_dir).read(0).where("path % 2 = 0")


@query(f"{_SNAPSHOTS}, c AS (SELECT fp || format('_chunk_{{:03d}}', i) AS chunk_id, fp FROM o, (SELECT unnest(range(3)) AS i)) SELECT chunk_id, fp FROM c WHERE fp NOT IN (SELECT fp FROM n)")
def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    chunks = old.select(F.explode(F.array(*[X.chunk_id("fp", F.lit(i)) for i in range(3)])).alias("chunk_id"))
    return St.orphans(chunks, new).select("chunk_id", "fp")


@query(f"""{_SNAPSHOTS}, s AS (SELECT path, CASE WHEN path % 13 = 0 THEN 'x' || fp ELSE fp END AS id FROM o), k AS (SELECT doc_id AS path FROM labels WHERE quality = 1)
 SELECT s.path, CASE WHEN NOT regexp_matches(id, '^[0-9a-f]{{32}}$') THEN 'bad_id' WHEN k.path IS NOT NULL THEN 'in_state' WHEN n.fp IS NULL THEN 'no_file' WHEN n.fp <> id THEN 'mismatch' ELSE 'reconciled' END AS status
 FROM s LEFT JOIN (SELECT DISTINCT path FROM k) k USING (path) LEFT JOIN n USING (path)""")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    stored = old.select("path", F.when(F.col("path") % 13 == 0, F.concat(F.lit("x"), "fp")).otherwise(F.col("fp")).alias("id"))
    return St.reconcile(stored, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("path")), new)


@query(f"{_SNAPSHOTS}, s AS (SELECT fp AS id FROM n UNION SELECT md5('ddl:' || p_brand || '.' || p_name) FROM part), e AS (SELECT DISTINCT fp AS id FROM o) SELECT coalesce(e.id, s.id) AS id, CASE WHEN e.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM e FULL JOIN s ON e.id = s.id")
def state_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    ids = [df.select(F.col(c).alias("id")) for df, c in ((old, "fp"), (new, "fp"))]
    tables = table(spark, sf_dir, "part").select(X.table_id("p_brand", "p_name").alias("id"))
    return St.rebuilt(ids[0], ids[1], tables)


@query(f"""{_SNAPSHOTS}, c AS (SELECT 'docs' AS kind, CASE WHEN path % 3 = 0 THEN CAST(path AS VARCHAR) ELSE fp END AS id FROM o UNION ALL SELECT 'chunks', fp || CASE WHEN path % 4 = 0 THEN '' ELSE '_chunk_001' END FROM o)
 SELECT kind, count(*) AS total, count(*) FILTER (WHERE NOT CASE WHEN kind = 'chunks' THEN regexp_matches(id, '^[0-9a-f]{{32}}_chunk_[0-9]+$') ELSE regexp_matches(id, '^[0-9a-f]{{32}}$') END) AS legacy FROM c GROUP BY kind""")
def legacy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _snapshots(spark, sf_dir)
    docs = old.select(F.lit("docs").alias("kind"), F.when(F.col("path") % 3 == 0, F.col("path").cast("string")).otherwise(F.col("fp")).alias("id"))
    chunks = old.select(F.lit("chunks").alias("kind"), F.concat("fp", F.when(F.col("path") % 4 == 0, "").otherwise("_chunk_001")).alias("id"))
    return docs.unionByName(chunks).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(X.is_legacy_id("kind", "id")).alias("legacy"))


@query("WITH d AS (SELECT doc_id, left(sha1(text), 16) AS sig FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'stale' ELSE sig END AS sig FROM d WHERE doc_id % 4 <> 0) SELECT c.sig IS NOT NULL AS hit, count(*) AS n FROM d LEFT JOIN c ON d.doc_id = c.doc_id AND d.sig = c.sig GROUP BY 1")
def token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.text_signature("text").alias("sig"), X.tokens("text").alias("made"))
    stale = F.when(F.col("doc_id") % 9 == 0, "stale").otherwise(F.col("sig"))
    cache = docs.where("doc_id % 4 <> 0").select("doc_id", stale.alias("sig"), F.col("made").alias("tokens"))
    found = St.cached_tokens(docs.drop("made"), cache)
    return found.groupBy(F.col("tokens").isNotNull().alias("hit")).agg(F.count("*").alias("n"))


@query("SELECT lang, source, CAST(grouping_id(lang, source) AS INTEGER) AS level, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("textloom_documents")
    return spark.sql("SELECT lang, source, cast(grouping_id(lang, source) AS int) AS level, count(*) AS n_docs, sum(n_chars) AS n_chars FROM textloom_documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query("SELECT d.lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS n_good, round(avg(d.n_chars), 6) AS avg_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("known", F.lit(1))
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("known").alias("n_labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("n_good"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query("WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1850)) AS s FROM documents WHERE length(text) > 0) SELECT doc_id, lang, CAST(s // 1850 AS INTEGER) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM c JOIN documents USING (doc_id)")
def doc_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.chunk import fixed_windows

    docs = table(spark, sf_dir, "documents")
    chunks = fixed_windows(docs, least=0).select("doc_id", "chunk_index")
    return St.by_document(chunks.join(docs.select("doc_id", "lang"), "doc_id")).select("doc_id", "lang", "chunk_index", "total_chunks")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return docs.orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(25)


@query("SELECT d.doc_id, d.lang FROM documents d WHERE contains(d.text, 'stupid') AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("stupid"))
    return docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")
