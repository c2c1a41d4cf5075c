"""Queries: text functions, filters, chunks and duplicates over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions import text as X
from textloom.operators import chunk as C
from textloom.operators import code as Code
from textloom.operators import parsers as P
from textloom.operators import state as St
from textloom.plans import chunk_sql
from textloom.plans.base import query
from textloom.sources.tables import table

_S = {k: v.replace("'", "''") for k, v in fixed.SANITISE.items()}
_MODERATE = f"regexp_replace(regexp_replace(text, '{_S['phone']}', '***', 'g'), '{_S['email']}', '***', 'g')"
_STRICT = "text"
for _k in fixed.SANITISE:
    _STRICT = f"regexp_replace({_STRICT}, '{_S[_k]}', '***', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"SELECT doc_id, md5({_MODERATE}) AS digest, CAST(length({_MODERATE}) AS BIGINT) AS n FROM documents")
def sanitize_moderate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.sanitise("text", "moderate")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({_STRICT}) AS digest, CAST(length({_STRICT}) AS BIGINT) AS n FROM documents")
def sanitize_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.sanitise("text", "strict")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query("SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n_{k}" for k, p in _S.items()) + " FROM documents")
def sanitize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(*[F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long").alias(f"n_{k}") for k, p in fixed.SANITISE.items()])


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.md5(X.plain_html("html")).alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.clean("text")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.preview("text").alias("preview"))


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'pathetic') AS place FROM documents), q AS (SELECT *, greatest(1, place - 50) AS b, place + 108 - greatest(1, place - 50) AS w FROM p)
 SELECT doc_id, CASE WHEN place > 0 THEN CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, w) || CASE WHEN b + w <= length(text) THEN '...' ELSE '' END
 WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM q""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.snippet("text", "pathetic").alias("snippet"))


@query(r"""SELECT doc_id, md5(CASE WHEN length(text) <= 8000 THEN text ELSE left(text, 5600) || chr(10) || '[truncated ' || (length(text) - 7920) || ' chars]' || chr(10) || right(text, 2320) END) AS digest FROM documents""")
def smart_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.smart_extract("text")).alias("digest"))



@query(rf"SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext, lower(regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1')) AS key FROM pages")
def ext_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.extension("url").alias("ext"), X.dedup_key("url").alias("key"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(%s), '{'|'.join(p)}') THEN '{n}'" for n, p in fixed.CATEGORIES.items()) + f" ELSE '{fixed.OTHER_CATEGORY}' END"


@query(f"SELECT {_CATEGORY.replace('%s', 'text')} AS category, count(*) AS n FROM documents GROUP BY 1")
def classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(X.category("text").alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN format('{:.2f} B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN format('{:.2f} KB', n_chars / 1024.0::DOUBLE) ELSE format('{:.2f} MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.human_size("n_chars").alias("size"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
 SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END + length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS BIGINT) AS n_tokens FROM c""")
def budget_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.count_tokens("text").alias("n_tokens"))


_PIECES = "|".join(p.replace(".", r"\.") for p in fixed.EXCLUDED_PATH_PIECES)


@query(f"SELECT page_id, regexp_matches(url, '{_PIECES}|{fixed.EXCLUDED_PATH_PATTERN}') AS excluded FROM pages")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.is_excluded_path("url").alias("excluded"))


@query(f"SELECT p_partkey FROM part WHERE NOT (regexp_matches(p_brand, '{fixed.EXCLUDED_DATABASES}') OR regexp_matches(replace(p_name, ' ', '_') || CASE WHEN p_size % 7 = 0 THEN '_bak' ELSE '' END, '{fixed.EXCLUDED_TABLES}'))")
def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_size") % 7 == 0, "_bak").otherwise(""))
    return table(spark, sf_dir, "part").where(~X.is_excluded_table("p_brand", name)).select("p_partkey")


@query(r"SELECT doc_id, left(sha256(source || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g')), 32) AS fp, left(sha1(text), 16) AS sig, left(sha256(source || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g')), 32) || format('_chunk_{:03d}', doc_id % 7) AS chunk_id FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = X.content_fingerprint("source", "text")
    return _docs(spark, sf_dir).select("doc_id", fp.alias("fp"), X.text_signature("text").alias("sig"), X.chunk_id(fp, F.col("doc_id") % 7).alias("chunk_id"))


@query("SELECT p_partkey, md5('ddl:' || p_brand || '.' || p_name) AS id FROM part")
def ddl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.table_id("p_brand", "p_name").alias("id"))


# --- chunks -------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1850)) AS start, text FROM documents)
 SELECT doc_id, CAST(start // 1850 AS INTEGER) AS chunk_index, md5(substr(text, start + 1, 2000)) AS digest FROM c WHERE length(substr(text, start + 1, 2000)) >= 200""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_windows(_docs(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 638)) AS start FROM w)
 SELECT doc_id, CAST(start // 638 AS INTEGER) AS chunk_index, md5(array_to_string(w[start + 1:start + 750], ' ')) AS digest FROM c""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_windows(_docs(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query("""WITH s AS (SELECT doc_id, unnest(range(0, length(text), 1850)) AS start, text FROM documents), c AS (SELECT doc_id, start // 1850 AS i, substr(text, start + 1, 2000) AS chunk FROM s WHERE length(substr(text, start + 1, 2000)) >= 200),
 l AS (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(CASE WHEN length(before) > 150 THEN '...' || right(before, 150) || chr(10) ELSE '' END || chunk) AS digest FROM l""")
def chunk_overlap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_overlap(C.fixed_windows(_docs(spark, sf_dir))).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), c AS (SELECT doc_id, a, unnest(range(0, len(a), 50)) AS start FROM l)
 SELECT doc_id, CAST(start // 50 AS INTEGER) AS chunk_index, md5(array_to_string(a[start + 1:start + 50], chr(10))) AS digest FROM c""")
def chunk_lines50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_blocks(_docs(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query("""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM a),
 s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The |^# ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
 SELECT doc_id, CAST(section AS BIGINT) AS section, arg_min(line, pos) AS title, CAST(min(pos) AS INTEGER) AS first_line, CAST(max(pos) AS INTEGER) AS last_line, count(*) AS n_lines FROM s GROUP BY doc_id, section""")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that begin at lines with a heading's start."""
    return C.header_sections(_docs(spark, sf_dir), "^The |^# ")


@query("""WITH f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 OR length(text) >= 200 THEN 1 ELSE 0 END AS s FROM conversations),
 n AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM f)
 SELECT conv_id, CAST(i AS BIGINT) AS chunk_index, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest, CAST(count(*) AS INTEGER) AS n_turns FROM n GROUP BY conv_id, i""")
def chunk_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dialogues(table(spark, sf_dir, "conversations")).select("conv_id", "chunk_index", F.md5("chunk").alias("digest"), "n_turns")


_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 n AS (SELECT *, len(list_filter(string_split_regex(chunk, '\\s+'), lambda x: x <> '')) AS n_words FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk"))


@query(f"""{_LINES}, s AS (SELECT *, CASE WHEN n_words < 50 AND coalesce(lag(n_words) OVER w < 50, FALSE) THEN 0 ELSE 1 END AS st FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), u AS (SELECT *, floor((sum(n_words) OVER (PARTITION BY doc_id, run ORDER BY i) - 1) / 750.0) AS part FROM r)
 SELECT doc_id, CAST(min(i) AS INTEGER) AS first_index, count(*) AS n_merged, CAST(sum(n_words) AS BIGINT) AS n_words, md5(string_agg(chunk, chr(10) ORDER BY i)) AS digest FROM u GROUP BY doc_id, run, part""")
def chunk_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines joined with their neighbours."""
    return C.merge_small(_lines(spark, sf_dir)).select("doc_id", "first_index", "n_merged", "n_words", F.md5("chunk").alias("digest"))


@query(f"{_LINES} SELECT doc_id, bool_and(n_words <= 150) AS valid FROM n GROUP BY 1")
def chunk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.valid_documents(_lines(spark, sf_dir), 150)


@query(chunk_sql.MARKDOWN)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed(_docs(spark, sf_dir), "markdown")


@query(chunk_sql.FORCE)
def chunk_force_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed(_docs(spark, sf_dir), "force")


@query(chunk_sql.PARAGRAPHS)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed(_docs(spark, sf_dir), "paragraphs")


@query(chunk_sql.SENTENCES)
def chunk_sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed(_docs(spark, sf_dir), "sentences")


@query("""WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
 SELECT doc_id, 'class' AS kind, 'C' || doc_id AS symbol, 1 AS first_line, CAST(4 * n + 2 AS INTEGER) AS last_line, 0 AS depth FROM d
 UNION ALL SELECT doc_id, 'function', 'f' || i, CAST(4 * i + 2 AS INTEGER), CAST(4 * i + 5 AS INTEGER), 1 FROM (SELECT doc_id, unnest(range(n)) AS i FROM d)""")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sources written from the documents: a class with a function for each line, the line as its comment, and braces in strings."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("function f"), i.cast("string"), F.lit("() {\n  // { "), line, F.lit("\n  var s = '}' + \"{\";\n}\n")))
    source = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(" {\n"), F.array_join(lines, ""), F.lit("}\n"))
    return Code.code_blocks(_docs(spark, sf_dir).select("doc_id", source.alias("text")), "javascript")


@query()
def chunk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the first separator that leaves none too heavy."""
    return C.packed(_docs(spark, sf_dir), "cascade").select("doc_id", "chunk_index", F.md5("chunk").alias("digest"), F.length("chunk").alias("n_chars"))


@query(chunk_sql.STATEMENTS)
def chunk_sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed(_docs(spark, sf_dir), "sql")


@query(chunk_sql.ROUTED)
def chunk_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the packer of its extension."""
    ext = F.element_at(F.array(*map(F.lit, (".md", ".sql", ".txt", ".log"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/files/"), F.when(F.col("doc_id") % 3 == 0, "cursor_").otherwise("note_"), F.col("doc_id").cast("string"), ext)
    chunks = C.routed_chunks(_docs(spark, sf_dir).withColumn("path", path))
    return chunks.select("doc_id", "chunk_index", "heading", F.md5("chunk").alias("digest"), "type")


@query(chunk_sql.SLIDES)
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decks of slides, five lines each: a title, three shapes, notes."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 5 == 0, "title").when(F.col("pos") % 5 == 4, "notes").otherwise("text")
    shapes = lines.select(F.col("doc_id").alias("deck"), F.floor(F.col("pos") / 5).cast("int").alias("slide"), (F.col("pos") % 5).alias("shape"), kind.alias("kind"), "text")
    return C.slide_chunks(P.slides(shapes), 40).select("deck", "slide", "title", "has_notes", "chunk_index", F.md5("chunk").alias("digest"))


# --- duplicates ------------------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS k FROM documents) SELECT doc_id, source, h FROM r WHERE k = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return St.keep_first(rows, "h", [F.col("source"), F.col("doc_id")])


@query("WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS original FROM h GROUP BY h HAVING count(*) > 1) SELECT original, doc_id AS duplicate, h FROM h JOIN f USING (h) WHERE doc_id <> original")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.duplicate_pairs(_docs(spark, sf_dir).select("doc_id", F.md5("text").alias("h")), "h", "doc_id")


@query(r"WITH r AS (SELECT page_id, lower(regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1')) AS key, row_number() OVER (PARTITION BY lower(regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1')) ORDER BY page_id) AS k FROM pages) SELECT page_id, key FROM r WHERE k = 1")
def dedup_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.keep_first(_pages(spark, sf_dir).select("page_id", X.dedup_key("url").alias("key")), "key", [F.col("page_id")])
