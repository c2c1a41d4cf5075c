"""Personal data: base patterns, and terms that disclose the entities they stand beside. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found leftmost and without overlap for
each kind; matches that fail their kind's test are dropped and not tried again. Positions come from splitting the text by
the pattern: what lies between the matches and the matches themselves add up to them. The patterns start only where a run of
their first characters starts (or where the last match ended) and hold on to what they took, which finds the same matches
in one pass over texts of any length.

Disclosing terms follow information-theoretic sanitisation. Every value found is an entity e. A term t (``TERM``: a word of
letters, in no e-mail address) discloses it as far as seeing t tells of e, wherever in the document both stand: their pointwise mutual
information PMI(t; e) = log2 p(t, e) / (p(t) p(e)), with probabilities as shares of all documents: those that hold both, those that hold t
anywhere, those that hold e. The share of e's own information content -log2 p(e) that t tells is held
against two thresholds: from ``alpha`` on t is generalised wherever it stands in a document with e (a span of kind ``term``), from ``beta``
on it is removed there (kind ``cut``), as it tells all there is to know. Evidence must come from at least ``support`` different
surroundings of e, ``SURROUNDINGS`` characters to each side, in documents that hold t: documents that are copies of one another, or nearly
so, repeat one surrounding and count once. Surroundings only tell copies apart; terms are taken from the whole text.

Only documents with entities are looked at for terms. Entities without evidence go first, then terms that are in too many documents for
every entity they meet; terms that stand in the same documents are one class, as they tell the same. So a text's entities meet its classes
and not each of its words. Counts of terms run over all documents; up to a checked number of candidate terms they are broadcast, beyond it
all terms are counted and then joined.

Defined cases: null text counts as empty and gives no spans; null doc_ids and repeated rows are rows of their own; an empty
table gives no rows; very long texts, and texts with very many spans, are read whole in one pass; other columns, of any names, pass
through ``sanitise`` unchanged, but n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import free_name, numbered, written

KINDS = ("email", "ip", "card", "phone", "term", "cut")
BASE = KINDS[:4]
# The patterns as given, with possessive loops and run starts; and what a text must hold to be worth a try.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9][\x20().0-9-]*[0-9]"}
TERM = r"\p{L}{4,}"
#: How far from an entity terms are looked for: over the whole text, as no text is longer.
REACH = (1 << 31) - 1
#: Characters to each side of an entity that tell whether documents repeat one another.
SURROUNDINGS = 60
ALPHA, BETA = 0.9, 1.0
SUPPORT = 2
BLOCK = 256
#: Candidate terms or entities, and rows with spans, that are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 1 << 18
BROADCAST_ROWS = 1 << 15


def _pieces(text: Column, pattern: str) -> Column:
    """[(what stands before it, match), ..., (what is left, null)]"""
    return F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def _placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """found (keys, at, before, match) with start and stop of each match, in code points."""
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = found.select(*keys, "at", F.length("before").alias("gap"), "match")
    stop = F.sum(F.col("gap") + F.length(F.coalesce("match", F.lit("")))).over(upto)
    return lengths.withColumn("stop", stop).where("match is not null").withColumn("start", F.col("stop") - F.length("match"))


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    number = lambda c: F.ascii(c) - 48
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    # from the right, every second digit is doubled
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(number(F.substr(digits, i, F.lit(1))))).otherwise(number(F.substr(digits, i, F.lit(1)))),
    )
    octets = F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(999)) <= 255)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(12, 19), luhn % 10 == 0).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, stop, value) of the base spans of rows (row, text)."""
    text = F.col("text")
    tried = F.array(*[F.when(text.rlike(HINTS[k]), F.struct(F.lit(k).alias("kind"), _pieces(text, p).alias("pieces"))) for k, p in PATTERNS.items()])
    kinds = rows.select("row", F.explode(F.filter(tried, lambda x: x.isNotNull())).alias("x"))
    found = kinds.select("row", F.col("x.kind").alias("kind"), F.posexplode("x.pieces").alias("at", "piece")).select("row", "kind", "at", "piece.before", "piece.match")
    placed = _placed(found, ["row", "kind"]).where(_valid(F.col("kind"), F.col("match")))
    value = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))
    return placed.select("row", "kind", F.col("start").cast("int"), F.col("stop").cast("int"), F.concat_ws(":", "kind", value).alias("value"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop of the text that was cut in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.greatest(F.lit(0), F.ceil(stop / BLOCK).cast("int") - first))
    return F.substring(F.array_join(some, ""), start % BLOCK + 1, stop - start)


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_TERMS else table


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def beside(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, text): the whole texts with entities, e-mail addresses (other base spans have no letters) as blanks; and (row, value, around): the
    entities, with digests of their surroundings."""
    here = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "value")).alias("spans"))
    # addresses become blanks, as many as they have characters
    blank = F.transform(_pieces(F.col("text"), PATTERNS["email"]), lambda p: F.concat(p["before"], F.regexp_replace(F.coalesce(p["match"], F.lit("")), "(?s).", " ")))
    hinted = rows.where(F.col("text").rlike("|".join(HINTS.values())))
    texts = written(hinted.join(here, "row").select("row", "spans", F.array_join(blank, "").alias("text")), "pii-texts")
    cut = texts.select("row", "spans", F.length("text").alias("size"), _blocks(F.col("text")).alias("blocks")).select("row", "size", "blocks", F.explode("spans").alias("x"))
    begin, end = F.greatest(F.lit(0), F.col("x.start") - SURROUNDINGS), F.least(F.col("size"), F.col("x.stop") + SURROUNDINGS)
    around = cut.select("row", F.col("x.value").alias("value"), F.xxhash64(_between(F.col("blocks"), begin, end)).alias("around"))
    return texts.select("row", "text"), written(around.distinct(), "pii-places")


def disclosing(rows: DataFrame, texts: DataFrame, places: DataFrame, alpha: float = ALPHA, beta: float = BETA, support: int = SUPPORT) -> DataFrame:
    """(row, term, kind): the terms of each text that disclose an entity of it, to be generalised or removed."""
    total = rows.count()
    told = lambda n_te, n_t, n_e: F.log2(F.lit(float(total)) * n_te / (F.col(n_t) * F.col(n_e)))
    content = lambda n_e: F.log2(F.lit(float(total)) / F.col(n_e))
    # a term and an entity share no more documents than the rarer has; of a text's entities the most frequent leaves most room
    may = lambda n_t, n_e: told(F.least(n_t, n_e), n_t, n_e) >= alpha * content(n_e) - 1e-9
    entities = places.groupBy("value").agg(F.count_distinct("row").alias("n_e"), F.count_distinct("around").alias("seen")).where(F.col("seen") >= support)
    entities = places.join(_few(written(entities.select("value", "n_e"), "pii-entities")), "value")
    room = entities.groupBy("row").agg(F.max("n_e").alias("room"))
    # a term is in no fewer documents than those with entities that hold it: one that tells too little even so needs no count over all documents
    held = texts.join(room, "row").select("row", "room", F.explode(_terms(F.col("text"))).alias("term"))
    # terms of the same documents have the same digests
    digests = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"in{k}") for k in range(2)]
    terms = held.groupBy("term").agg(F.count("*").alias("n_least"), F.max("room").alias("room"), *digests).where(may("n_least", "room"))
    terms = written(terms, "pii-candidates")
    named = terms.select("term")
    anywhere = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    if named.count() <= BROADCAST_TERMS:
        anywhere = anywhere.join(F.broadcast(named), "term", "left_semi")
    counts = anywhere.groupBy("term").agg(F.count("*").alias("n_any"))
    # a word that an address touches is part of a longer one in the whole text
    terms = terms.join(counts, "term", "left").withColumn("n_t", F.greatest("n_least", F.coalesce("n_any", F.lit(0)))).where(may("n_t", "room"))
    terms = _few(written(terms.select("term", "n_t", "in0", "in1"), "pii-counts"))
    same = ["n_t", "in0", "in1"]
    held = held.select("row", "room", "term").join(terms, "term").where(may("n_t", "room")).select("row", "term", *same)
    held = written(held, "pii-held")
    meet = entities.join(held.select("row", *same).distinct(), "row").where(may("n_t", "n_e"))
    pairs = meet.groupBy("value", "n_e", *same).agg(F.count_distinct("row").alias("n_te"), F.count_distinct("around").alias("seen")).where(F.col("seen") >= support)
    known = told(F.col("n_te"), "n_t", "n_e")
    kind = F.when(known >= beta * content("n_e") - 1e-9, "cut").otherwise("term").alias("kind")
    kinds = pairs.where((known >= alpha * content("n_e")) & (known > 0)).select("value", *same, kind)
    kinds = meet.select("row", "value", *same).distinct().join(kinds, ["value", *same]).groupBy("row", *same).agg(F.min("kind").alias("kind"))  # cut comes before term
    return held.join(kinds, ["row", *same]).select("row", "term", "kind")


def all_spans(rows: DataFrame, alpha: float = ALPHA, beta: float = BETA, support: int = SUPPORT) -> DataFrame:
    """(row, spans): sorted spans (start, order, stop, kind, upto) of each row that has any; upto is the furthest end of the spans before.
    rows (row, text) is read several times."""
    spans = written(base_spans(rows), "pii-base")
    texts, places = beside(rows, spans)
    terms = written(disclosing(rows, texts, places, alpha, beta, support), "pii-terms")
    words = texts.join(terms.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(_pieces(F.col("text"), TERM)).alias("at", "piece"))
    words = _placed(words.select("row", "at", "piece.before", "piece.match"), ["row"]).select("row", F.lower("match").alias("term"), F.col("start").cast("int"), F.col("stop").cast("int"))
    terms = words.join(terms, ["row", "term"]).select("row", "kind", "start", "stop")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("order")
    both = spans.select("row", "kind", "start", "stop").unionByName(terms).select("row", "start", order, "stop", "kind")
    before = Window.partitionBy("row").orderBy("start", "order", "stop").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("upto", F.coalesce(F.max("stop").over(before), F.lit(0)))
    return both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "stop", "kind", "upto"))).alias("spans"))


def find(docs: DataFrame, alpha: float = ALPHA, beta: float = BETA, support: int = SUPPORT) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256 and spans of each row of docs. The numbered rows are written once: spans point at them,
    and another scan of docs may number them anew."""
    rows, row = numbered(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "pii-rows")
    rows = rows.withColumnRenamed(row, "row")
    spans = written(all_spans(rows.select("row", "text"), alpha, beta, support), "pii-spans")
    none = F.expr("cast(array() as array<struct<start:int,order:int,stop:int,kind:string,upto:int>>)")
    told = rows.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["order"] <= len(BASE))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return told.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, beta: float = BETA, support: int = SUPPORT) -> DataFrame:
    """docs with base spans generalised to their kind, and disclosing terms generalised or removed, all columns kept. The numbered rows are
    written once, as in find."""
    columns = docs.columns
    rows, row = numbered(docs, "pii-rows")
    found, blocks = free_name(rows, "__spans"), free_name(rows, "__blocks")
    texts = rows.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    spans = written(all_spans(texts, alpha, beta, support), "pii-spans").select(F.col("row").alias(row), F.col("spans").alias(found))
    if spans.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    joined = rows.join(spans, row, "left").withColumn(blocks, F.when(F.col(found).isNotNull(), _blocks(F.col("text"))))
    mark = lambda s: F.when(s["kind"] == "cut", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    # a span that begins inside those before only lengthens them
    put = lambda s: F.when(s["start"] >= s["upto"], F.concat(_between(F.col(blocks), s["upto"], s["start"]), mark(s))).otherwise("")
    last = F.array_max(F.transform(found, lambda s: s["stop"]))
    clean = F.concat(F.array_join(F.transform(found, put), ""), _between(F.col(blocks), last, F.length("text")))
    has = F.col(found).isNotNull()
    out = joined.withColumn("text", F.when(has, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*("`" + c.replace("`", "``") + "`" for c in columns))
