"""DuckDB's way to what the packers of ``operators.chunk`` cut: recursive steps where a piece depends on the one before."""

from __future__ import annotations

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NONE = "CAST(NULL AS VARCHAR) AS heading"


def _end(window: str, size: int = 2000, least: int = 200) -> str:
    """The end of a piece: behind the last break of the first kind that has one far enough in."""
    cases = []
    for b in ("\n\n", "\n", "。", ". ", "；", "; "):
        back = f"strpos(reverse({window}), '{b[::-1]}')"
        cases.append(f"WHEN {back} > 0 AND length({window}) - {back} + 1 - {len(b)} > {least} THEN length({window}) - {back} + 1")
    return f"CASE {' '.join(cases)} ELSE {size} END"


#: From d (doc_id, section, heading, t) to c (doc_id, section, heading, i, chunk).
_FORCED = f"""s AS (SELECT doc_id, section, heading, t, 0 AS pos, 0 AS i, substr(t, 1, 2000) AS w FROM d
 UNION ALL SELECT doc_id, section, heading, t, next, i + 1, substr(t, next + 1, 2000) FROM (SELECT *, pos + greatest(1, {_end('w')} - 150) AS next FROM s WHERE length(t) - pos > 2000)),
 p AS (SELECT doc_id, section, heading, i, length(t) - pos > 2000 AS whole, CASE WHEN length(t) - pos > 2000 THEN left(w, {_end('w')}) ELSE w END AS chunk FROM s),
 q AS (SELECT *, lead(chunk) OVER o AS rest, lead(whole) OVER o AS more FROM p WINDOW o AS (PARTITION BY doc_id, section ORDER BY i)),
 c AS (SELECT doc_id, section, heading, i, chunk || CASE WHEN NOT more AND length(rest) < 200 AND length(rest) > 150 THEN substr(rest, 151) ELSE '' END AS chunk
  FROM q WHERE whole OR (chunk <> '' AND (i = 0 OR length(chunk) >= 200)))"""

FORCE = f"""WITH RECURSIVE d AS (SELECT doc_id, 0 AS section, {_NONE}, coalesce(text, '') AS t FROM documents), {_FORCED}
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, heading, chunk FROM c"""

MARKDOWN = rf"""WITH RECURSIVE a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || '## ') AS a FROM documents),
 b AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) AS k FROM a),
 e AS (SELECT doc_id, k, CASE WHEN k > 1 THEN '## ' ELSE '' END || part AS part FROM b),
 f AS (SELECT *, regexp_matches(part, '\S') AS said FROM e),
 g AS (SELECT *, said AND (length(part) >= 200 OR coalesce(sum(said::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS starts FROM f),
 h AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM g),
 d AS (SELECT doc_id, section, left({_STRIP.format("regexp_replace(string_split(arg_min(part, k), chr(10))[1], '^[# ]+', '')")}, 200) AS heading, string_agg(part, chr(10) ORDER BY k) AS t
  FROM h WHERE section > 0 AND (starts OR length(part) < 200) GROUP BY doc_id, section), {_FORCED}
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS INTEGER) AS chunk_index, heading, chunk FROM c"""

PARAGRAPHS = rf"""WITH RECURSIVE a AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS a FROM documents),
 p AS MATERIALIZED (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) AS k FROM a),
 s AS (SELECT doc_id, k, 0 AS g, length(part) AS n FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN n + length(part) + 1 > 2000 AND n >= 200 THEN g + 1 ELSE g END, CASE WHEN n + length(part) + 1 > 2000 AND n >= 200 THEN length(part) ELSE n + length(part) + 1 END
  FROM s JOIN p ON p.doc_id = s.doc_id AND p.k = s.k + 1),
 last AS (SELECT doc_id, max(g) AS top, arg_max(n, k) AS n FROM s GROUP BY doc_id),
 m AS (SELECT doc_id, k, CASE WHEN g = top AND g > 0 AND last.n < 200 THEN g - 1 ELSE g END AS g FROM s JOIN last USING (doc_id))
 SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, {_NONE}, string_agg(part, chr(10) ORDER BY k) AS chunk FROM m JOIN p USING (doc_id, k) GROUP BY doc_id, g"""

SENTENCES = rf"""WITH RECURSIVE a AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
 b AS (SELECT doc_id, list_filter(string_split_regex(unnest(a), '\s+'), lambda x: x <> '') AS words, generate_subscripts(a, 1) AS k FROM a),
 c AS (SELECT doc_id, k, words, unnest(range(0, len(words), 1500)) AS start FROM b),
 p AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, start) AS k, words[start + 1:start + 1500] AS piece FROM c),
 s AS (SELECT doc_id, k, 0 AS g, len(piece) AS n FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN n + len(piece) > 750 THEN g + 1 ELSE g END, CASE WHEN n + len(piece) > 750 THEN len(piece) ELSE n + len(piece) END
  FROM s JOIN p ON p.doc_id = s.doc_id AND p.k = s.k + 1)
 SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, {_NONE}, string_agg(array_to_string(piece, ' '), ' ' ORDER BY k) AS chunk FROM s JOIN p USING (doc_id, k) GROUP BY doc_id, g"""

STATEMENTS = rf"""WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^;''"`]|''[^'']*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$))+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS a FROM documents)
 SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS chunk_index, {_NONE}, unnest(a) AS chunk FROM a"""


def _of(sql: str, where: str) -> str:
    return sql.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {where})")


#: Files whose extensions and names go by their number.
ROUTED = f"""WITH c AS (SELECT * FROM ({_of(MARKDOWN, 'doc_id % 4 = 0')}) UNION ALL SELECT * FROM ({_of(STATEMENTS, 'doc_id % 4 = 1')})
 UNION ALL SELECT * FROM ({_of(PARAGRAPHS, 'doc_id % 4 = 2')}) UNION ALL SELECT * FROM ({_of(FORCE, 'doc_id % 4 = 3')}))
 SELECT doc_id, chunk_index, heading, md5(chunk) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'cursor' ELSE 'narrative' END AS type FROM c"""

_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"

#: Documents as decks, five lines a slide: title, three shapes, notes; slides of more than 40 words are cut.
SLIDES = rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
 c AS (SELECT doc_id, pos // 5 AS slide, pos % 5 AS shape, {_STRIP.format('line')} AS t FROM l),
 d AS (SELECT doc_id, slide, max(t) FILTER (WHERE shape = 0) AS title, bool_or(shape = 4) AS has_notes, string_agg(CASE shape WHEN 0 THEN '标题: ' WHEN 4 THEN '备注: ' ELSE '' END || t, chr(10) ORDER BY shape) AS text FROM c WHERE t <> '' GROUP BY doc_id, slide),
 a AS (SELECT doc_id, slide, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE {_WORDS.format('text')} > 40),
 b AS (SELECT *, {_WORDS.format('part')} AS n FROM a),
 e AS (SELECT doc_id, slide, k, 0 AS j, 0 AS mode, part AS piece FROM b WHERE n <= 40
  UNION ALL SELECT doc_id, slide, k, generate_subscripts(string_split_regex(part, '[。！？；.!?;]'), 1), k, {_STRIP.format("unnest(string_split_regex(part, '[。！？；.!?;]'))")} FROM b WHERE n > 40),
 p AS MATERIALIZED (SELECT doc_id, slide, mode, piece, {_WORDS.format('piece')} AS n, row_number() OVER (PARTITION BY doc_id, slide ORDER BY k, j) AS i FROM e WHERE piece <> ''),
 s AS (SELECT doc_id, slide, i, 0 AS g, n AS used, mode FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.slide, p.i, CASE WHEN p.mode <> s.mode OR s.used + p.n > 40 THEN g + 1 ELSE g END, CASE WHEN p.mode <> s.mode OR s.used + p.n > 40 THEN p.n ELSE s.used + p.n END, p.mode
  FROM s JOIN p ON p.doc_id = s.doc_id AND p.slide = s.slide AND p.i = s.i + 1),
 f AS (SELECT doc_id, slide, g, CASE WHEN mode = 0 THEN string_agg(piece, chr(10) ORDER BY i) ELSE string_agg(piece, '。' ORDER BY i) END AS t, max(n) > 40 AS heavy FROM s JOIN p USING (doc_id, slide, i, mode) GROUP BY doc_id, slide, g, mode),
 h AS (SELECT doc_id, slide, g, 0 AS place, t AS chunk FROM f WHERE NOT heavy
  UNION ALL SELECT doc_id, slide, g, place, substr(t, place + 1, 60) FROM (SELECT *, unnest(range(0, length(t), 60)) AS place FROM f WHERE heavy)
  UNION ALL SELECT doc_id, slide, 0, 0, text FROM d WHERE {_WORDS.format('text')} <= 40)
 SELECT doc_id AS deck, CAST(slide AS INTEGER) AS slide, title, has_notes, CAST(row_number() OVER (PARTITION BY doc_id, slide ORDER BY g, place) - 1 AS INTEGER) AS chunk_index, md5(chunk) AS digest
 FROM h JOIN d USING (doc_id, slide) WHERE regexp_matches(chunk, '\S')"""
