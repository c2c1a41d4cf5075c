"""Text functions as columns: tokens, cleaning, sanitising, previews, keys and fingerprints. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed

#: What parts tokens: runs of anything but letters, numbers and underscores.
GAPS = r"[^\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, stopwords: Iterable[str] = (), least: int = 2) -> Column:
    """Lower-case words of at least ``least`` characters, without stopwords, repeats kept."""
    stop = list(stopwords)
    keep = lambda x: (F.length(x) >= least) & (~x.isin(stop) if stop else F.lit(True))
    return F.filter(F.split(F.lower(_col(text)), GAPS), keep)


def mixed_tokens(text: Column | str, unigrams: bool = True) -> Column:
    """Words for mixed scripts: latin runs cut to 20 characters, CJK text one character each (kept if ``unigrams``), stopwords dropped."""
    words = F.split(F.lower(_col(text)), GAPS)
    cjk = r"[一-鿿]"
    split = F.transform(
        words,
        lambda w: F.when(w.rlike(cjk), F.concat(F.regexp_extract_all(w, F.lit("[a-z]+"), F.lit(0)), F.regexp_extract_all(w, F.lit(cjk), F.lit(0)))).otherwise(F.array(F.substring(w, 1, 20))),
    )
    keep = lambda x: ~x.isin(fixed.MIXED_STOPWORDS) & ((F.length(x) >= 2) | (x.rlike(cjk) if unigrams else F.lit(False)))
    return F.filter(F.flatten(split), keep)


def keywords(text: Column | str) -> Column:
    """Words as written, longer than one character, without stopwords."""
    return F.filter(F.split(_col(text), GAPS), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(fixed.KEYWORD_STOPWORDS))


def clean(text: Column | str) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def count_tokens(text: Column | str) -> Column:
    """Blank-parted words, and CJK characters besides."""
    t = clean(text)
    return (F.when(t == "", 0).otherwise(F.size(F.split(t, " "))) + F.length(F.regexp_replace(t, r"[^一-鿿]", ""))).cast("long")


def embed_text(text: Column | str, max_tokens: int = 512) -> Column:
    """Text prepared for an embedding model: cleaned and cut to four characters a token."""
    return F.substring(clean(text), 1, 4 * max_tokens)


def sanitise(text: Column | str, mode: str = "moderate") -> Column:
    """Personal numbers and addresses replaced by ***: mode none, moderate (phone, email) or strict (all four)."""
    kinds = {"none": [], "moderate": ["phone", "email"], "strict": list(fixed.SANITISE)}[mode]
    out = _col(text)
    for kind in kinds:
        out = F.regexp_replace(out, fixed.SANITISE[kind], "***")
    return out


def plain_markdown(text: Column | str) -> Column:
    """Markdown without its marks: headings, emphasis, links, code fences, tags; blank lines merged."""
    out = _col(text)
    for pattern, put in (
        (r"(?m)^#+\s+", ""),
        (r"\*\*(.+?)\*\*", "$1"),
        (r"\*(.+?)\*", "$1"),
        (r"~~(.+?)~~", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"```\w*\n", ""),
        ("```", ""),
        (r"`([^`]+)`", "$1"),
        (r"<[^>]+>", ""),
        (r"\n\s*\n\s*\n", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def plain_html(html: Column | str) -> Column:
    """Text of a page: scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(_col(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return clean(F.regexp_replace(bare, r"<[^>]+>", " "))


def preview(text: Column | str, size: int = 200) -> Column:
    """The first characters, with ... where there are more."""
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def summary_preview(text: Column | str) -> Column:
    """A chunk's summary (after 摘要:, before --- or a blank line, without its key terms), else the first 200 of its body."""
    t = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    after = F.regexp_extract(t, r"(?s)摘要:(.*)$", 1)
    head = F.when(after.contains("\n---"), F.substring_index(after, "\n---", 1)).when(after.contains("\n\n"), F.substring_index(after, "\n\n", 1)).otherwise(F.substring(after, 1, 200))
    head = F.regexp_replace(F.regexp_replace(F.substring_index(head, "关键术语", 1), r"^\s+|\s+$", ""), "。+$", "")
    body = F.when(t.contains("\n---\n"), F.regexp_extract(t, r"(?s)\n---\n(.*)$", 1)).otherwise(t)
    return F.when(head != "", head).otherwise(F.substring(body, 1, 200))


def snippet(text: Column | str, query: str, size: int = 200) -> Column:
    """What stands around the query's first place, else the text's head."""
    t = _col(text)
    at = F.locate(query.lower(), F.lower(t))
    begin = F.greatest(F.lit(1), at - 50)
    width = at + len(query) + 100 - begin
    end = begin + width
    found = F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), F.substring(t, begin, width), F.when(end <= F.length(t), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, found).otherwise(preview(t, size))


def smart_extract(text: Column | str, size: int = 8000) -> Column:
    """Long code as its head (70 %) and tail with a note between; short code as it is. Cut at characters."""
    t = _col(text)
    head = int(size * 0.7)
    tail = size - head - 80
    note = F.concat(F.lit("\n[truncated "), (F.length(t) - (head + tail)).cast("string"), F.lit(" chars]\n"))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, head), note, F.right(t, F.lit(tail))))


def extract_for_embedding(path: Column | str, text: Column | str, doc_chars: int = 2000, code_chars: int = 8000) -> Column:
    """Code by head and tail, documents by their head."""
    return F.when(extension(path).isin(fixed.CODE_EXTENSIONS), smart_extract(text, code_chars)).otherwise(F.substring(_col(text), 1, doc_chars))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dedup_key(path: Column | str) -> Column:
    """A hit's key: the lower-case file name without its last extension."""
    return F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""))


def human_size(n: Column | str) -> Column:
    """Bytes as B to PB with two decimals."""
    n = _col(n).cast("double")
    out = F.format_string("%.2f PB", F.bround(n / 1024.0**5, 2))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(n / 1024.0**k, 2))).otherwise(out)
    return out


def category(path: Column | str) -> Column:
    """The first category that any of its pieces of text puts the path into."""
    p = F.lower(_col(path))
    out = None
    for name, pieces in fixed.CATEGORIES.items():
        hit = p.rlike("|".join(map(re.escape, pieces)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fixed.OTHER_CATEGORY)


def content_fingerprint(path: Column | str, text: Column | str) -> Column:
    stripped = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.substring(F.sha2(F.concat(_col(path), F.lit(":"), stripped), 256), 1, 32)


def chunk_id(fingerprint: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_chunk_%03d", _col(fingerprint), _col(index))


def table_id(database: Column | str, table: Column | str) -> Column:
    return F.md5(F.concat(F.lit("ddl:"), _col(database), F.lit("."), _col(table)))


def text_signature(text: Column | str) -> Column:
    return F.substring(F.sha1(F.coalesce(_col(text), F.lit(""))), 1, 16)


def is_excluded_path(path: Column | str) -> Column:
    pieces = "|".join(map(re.escape, fixed.EXCLUDED_PATH_PIECES))
    return _col(path).rlike(f"{pieces}|{fixed.EXCLUDED_PATH_PATTERN}")


def is_low_value_file(path: Column | str) -> Column:
    return basename(path).rlike("(?i)" + "|".join(fixed.LOW_VALUE_PATTERNS))


def is_excluded_table(database: Column | str, table: Column | str) -> Column:
    return F.coalesce(_col(database).rlike(fixed.EXCLUDED_DATABASES), F.lit(False)) | F.coalesce(_col(table).rlike(fixed.EXCLUDED_TABLES), F.lit(False))


def is_legacy_id(kind: Column | str, id: Column | str) -> Column:
    shape = F.when(_col(kind) == "chunks", _col(id).rlike(r"^[0-9a-f]{32}_chunk_[0-9]+$")).otherwise(_col(id).rlike("^[0-9a-f]{32}$"))
    return ~F.coalesce(shape, F.lit(False))


def citations(answer: Column | str) -> Column:
    return F.regexp_extract_all(_col(answer), F.lit(r"\[文档[0-9]+\]"), F.lit(0))


def groundedness(answer: Column | str, context: Column | str) -> Column:
    """The share of the answer's words that the context's words (3 letters or more) hold; 0.8 of it without citations."""
    said = F.filter(F.split(F.lower(_col(answer)), GAPS), lambda w: F.length(w) >= 1)
    known = F.array_distinct(F.filter(F.split(F.lower(_col(context)), GAPS), lambda w: F.length(w) >= 3))
    share = F.size(F.filter(said, lambda w: F.array_contains(known, w))) / F.greatest(F.size(said), F.lit(1))
    return F.least(F.lit(1.0), F.when(F.size(citations(answer)) > 0, share).otherwise(share * 0.8))


def answer_issues(answer: Column | str, grounded: Column | str, longest: int = 2000) -> Column:
    """What is wrong with an answer: empty, ungrounded, uncited, too long."""
    a = _col(answer)
    return F.array_compact(
        F.array(
            F.when(F.trim(a) == "", "empty"),
            F.when(_col(grounded) < 0.3, "low_groundedness"),
            F.when(F.size(citations(a)) == 0, "no_citation"),
            F.when(F.length(a) > longest, "too_long"),
        )
    )


def sql_without_comments(sql: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(sql), r"(?m)--[^\n]*$", ""), r"(?s)/\*.*?\*/", "")


def referenced_tables(sql: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(sql), F.lit(r"(?i)(?:FROM|JOIN)\s+(?:\w+\.)?(\w+)"), F.lit(1)))
