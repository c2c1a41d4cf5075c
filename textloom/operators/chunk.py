"""Chunkers: documents to rows of chunks. Those that SQL can say are plain columns; packers, which carry state from piece to
piece, are small generators run by one mapInArrow over the documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import fixed

CHUNK = "doc_id long, chunk_index int, heading string, chunk string"
SIZE, LEAST, OVERLAP = 2000, 200, 150


def fixed_windows(docs: DataFrame, width: int = SIZE, stride: int = SIZE - OVERLAP, least: int = LEAST) -> DataFrame:
    """Windows of width characters every stride characters; short ones are dropped. A text is cut once into blocks of a stride, and a window
    is its own block and what it needs of those behind it, so the work is linear in the text."""
    blocks = docs.where(F.length("text") > 0).select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), 0).alias("blocks"))
    behind = range(1, -(-width // stride))

    def window(block, i):
        return F.substring(F.concat(block, *[F.coalesce(F.get("blocks", i + n), F.lit("")) for n in behind]), 1, width)

    windows = blocks.select("doc_id", F.posexplode(F.transform("blocks", window)).alias("chunk_index", "chunk"))
    return windows.where(F.length("chunk") >= least)


def word_windows(docs: DataFrame, width: int = 750, stride: int = 638) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))
    return rows.select("doc_id", "words", F.posexplode(starts).alias("chunk_index", "start")).select("doc_id", "chunk_index", F.array_join(F.slice("words", F.col("start") + 1, width), " ").alias("chunk"))


def line_blocks(docs: DataFrame, lines: int = 50) -> DataFrame:
    """Blocks of a number of lines."""
    rows = docs.select("doc_id", F.split("text", "\n").alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(lines))
    return rows.select("doc_id", "all", F.posexplode(starts).alias("chunk_index", "start")).select("doc_id", "chunk_index", F.array_join(F.slice("all", F.col("start") + 1, lines), "\n").alias("chunk"))


def header_sections(docs: DataFrame, header: str = r"^#{1,6} ") -> DataFrame:
    """Sections of lines, each from one header to the next: index, title, level, first and last line, number of lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    is_header = F.col("line").rlike(header)
    w = Window.partitionBy("doc_id").orderBy("pos")
    numbered = lines.withColumn("section", F.sum(is_header.cast("int")).over(w))
    return numbered.groupBy("doc_id", "section").agg(
        F.min_by("line", "pos").alias("title"), F.min("pos").alias("first_line"), F.max("pos").alias("last_line"), F.count("*").alias("n_lines")
    )


def with_overlap(chunks: DataFrame, size: int = OVERLAP) -> DataFrame:
    """Each chunk behind the tail of the one before it."""
    before = F.lag("chunk").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    tail = F.when(F.length(before) > size, F.concat(F.lit("..."), F.right(before, F.lit(size)), F.lit("\n"))).otherwise("")
    return chunks.withColumn("chunk", F.concat(F.coalesce(tail, F.lit("")), F.col("chunk")))


def dialogues(turns: DataFrame, least: int = LEAST) -> DataFrame:
    """Turns of a conversation as chunks; a turn shorter than ``least`` joins the one before it (the first stays)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    starts = (F.row_number().over(w) == 1) | (F.length("text") >= least)
    numbered = turns.withColumn("chunk_index", F.sum(starts.cast("int")).over(w) - 1)
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return numbered.groupBy("conv_id", "chunk_index").agg(said.alias("said")).select("conv_id", "chunk_index", F.array_join(F.transform("said", lambda s: F.concat_ws(": ", s["role"], s["text"])), "\n").alias("chunk"), F.size("said").alias("n_turns"))


def merge_small(chunks: DataFrame, least: int = 50, budget: int = 750) -> DataFrame:
    """Neighbouring chunks of fewer than ``least`` words joined while their words fit the budget; chunks (doc_id, chunk_index, chunk)."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    n = F.size(F.filter(F.split("chunk", r"\s+"), lambda x: x != ""))
    small = F.col("n_words") < least
    runs = chunks.withColumn("n_words", n).withColumn("starts", (~small | ~F.coalesce(F.lag(small).over(w), F.lit(False))).cast("int"))
    numbered = runs.withColumn("run", F.sum("starts").over(w))
    used = F.sum("n_words").over(Window.partitionBy("doc_id", "run").orderBy("chunk_index"))
    grouped = numbered.withColumn("part", F.floor((used - 1) / budget))
    lines = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    told = grouped.groupBy("doc_id", "run", "part").agg(F.min("chunk_index").alias("first_index"), F.count("*").alias("n_merged"), F.sum("n_words").alias("n_words"), lines.alias("x"))
    return told.select("doc_id", "first_index", "n_merged", "n_words", F.array_join(F.transform("x", lambda c: c["chunk"]), "\n").alias("chunk"))


def valid_documents(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """(doc_id, valid): whether no chunk of a document has more than ``most`` words."""
    n = F.size(F.filter(F.split("chunk", r"\s+"), lambda x: x != ""))
    return chunks.groupBy("doc_id").agg(F.bool_and(n <= most).alias("valid"))


# --- packers: text -> (heading, chunk), ... ------------------------------------------------------------------------------


def force_split(text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP) -> Iterator[str]:
    """Windows of at most size characters that end at the last break in them; a short remainder joins the last."""
    breaks = ("\n\n", "\n", "。", ". ", "；", "; ")
    found: list[str] = []
    at = 0
    while len(text) - at > size:
        window = text[at : at + size]
        end = next((k + len(b) for b in breaks if (k := window.rfind(b)) > least), size)
        found.append(window[:end])
        at += max(1, end - overlap)
    rest = text[at:]
    if found and len(rest) < least:
        found[-1] += rest[overlap:] if len(rest) > overlap else ""
    elif rest:
        found.append(rest)
    return iter(found)


def markdown_sections(text: str, size: int = SIZE, least: int = LEAST) -> Iterator[tuple[str, str]]:
    """Second-level sections; short ones join the one before, long ones are split at breaks."""
    held: list[list[str]] = []
    for part in re.split(r"\n(?=## )", text):
        heading = part.split("\n", 1)[0].lstrip("# ").strip()[:200]
        if len(part) < least and held:
            held[-1][1] += "\n" + part
        elif part.strip():
            held.append([heading, part])
    for heading, part in held:
        for piece in force_split(part, size, least) if len(part) > size else [part]:
            yield heading, piece


def merged_paragraphs(parts: list[str], size: int = SIZE, least: int = LEAST) -> Iterator[str]:
    """Paragraphs packed up to size; what is too short goes on with the next, and at the end joins the last."""
    held, found = "", []
    for part in (p.strip() for p in parts):
        if not part:
            continue
        if held and len(held) + len(part) + 1 > size and len(held) >= least:
            found.append(held)
            held = part
        else:
            held = f"{held}\n{part}" if held else part
    if held and found and len(held) < least:
        found[-1] += "\n" + held
    elif held:
        found.append(held)
    return iter(found)


def sentence_pack(text: str, budget: int = 750, most: int = 1500) -> Iterator[str]:
    """Sentences packed up to a budget of words; a longer sentence is cut."""
    held: list[str] = []
    used = 0
    for sentence in re.split(r"(?<=[。！？.!?])\s*", text):
        words = sentence.split()
        for i in range(0, len(words), most):
            piece = words[i : i + most]
            if held and used + len(piece) > budget:
                yield " ".join(held)
                held, used = [], 0
            held.append(" ".join(piece))
            used += len(piece)
    if held:
        yield " ".join(held)


def weight(text: str) -> int:
    """A text's size for the cascade: words parted by blanks, and Han characters."""
    return len(text.split()) + sum("\u4e00" <= c <= "\u9fff" for c in text)


def n_words(text: str) -> int:
    return len(text.split())


def stretches(text: str, size: int) -> Iterator[str]:
    """A text in stretches of characters, blank ones left out."""
    return filter(str.strip, (text[i : i + size] for i in range(0, len(text), size)))


def filled(pieces: Iterator[str], joint: str, budget: int, most: int, finer: Callable[[str], Iterator[str]], weight: Callable[[str], int] = weight) -> Iterator[str]:
    """Pieces put together up to a budget; one that is heavier than ``most`` by itself is cut by ``finer``."""
    held: list[str] = []
    used = 0
    for piece in pieces:
        size = weight(piece)
        if used + size > budget:
            if held:
                yield joint.join(held)
            held, used = [], 0
            if size > most:
                yield from finer(piece)
                continue
        held.append(piece)
        used += size
    if held:
        yield joint.join(held)


def separator_cascade(text: str, budget: int = 750, most: int = 1500, separators: list[str] = fixed.CASCADE_SEPARATORS) -> Iterator[str]:
    """Chunks of a text, blanks run together: whole if it fits the budget, else parted by the first of the separators that leaves no chunk heavier than
    ``most``. A part that is too heavy is cut into sentences, and such a sentence into stretches of characters (four for each unit of the budget),
    which is also what is left where no separator will do. Each separator is one pass over the text."""
    text = " ".join(text.split())
    stretch = 4 * budget
    by_characters = partial(stretches, size=stretch)
    sentences = lambda t: filled(filter(None, map(str.strip, re.split("[.!?。！？]", t))), "。", budget, most, by_characters)
    if weight(text) <= budget:
        return iter([text] if text else [])
    for separator in separators:
        parts = text.split(separator)
        marked = [p.strip() + (separator if i < len(parts) - 1 else "") for i, p in enumerate(parts) if p.strip()]
        found = list(filled(iter(marked), "", budget, most, lambda t, s=separator: sentences(t.removesuffix(s))))
        if found and all(weight(c) <= most for c in found):
            return iter(found)
    return by_characters(text)


def slide_pieces(text: str, most: int = 800) -> Iterator[str]:
    """A slide whole if it has at most ``most`` words; else its paragraphs put together up to that, a longer paragraph by its sentences, and a
    longer sentence by its characters (three for two words of the bound)."""
    if n_words(text) <= most:
        return iter([text] if text.strip() else [])
    by_characters = partial(stretches, size=most * 3 // 2)
    sentences = lambda t: filled(filter(None, map(str.strip, re.split("[。！？；.!?;]", t))), "。", most, most, by_characters, n_words)
    return filled(iter(text.split("\n")), "\n", most, most, sentences, n_words)


def sentence_windows(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> Iterator[str]:
    """Windows that end at a sentence where one ends in their second half, each beginning overlap characters back."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(x, at + size // 2, end) for x in "。.!?\n")
            end = cut + 1 if cut > 0 else end
        piece = text[at:end]
        if len(piece) >= least or at == 0:
            yield piece
        if end == len(text):
            return
        at = max(at + 1, end - overlap)


def sql_statements(text: str) -> Iterator[str]:
    """Statements parted by semicolons outside quotes."""
    start, quote = 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            if text[start:k].strip():
                yield text[start:k].strip()
            start = k + 1
    if text[start:].strip():
        yield text[start:].strip()


PACKERS: dict[str, Callable[[str], Iterator]] = {
    "markdown": markdown_sections,
    "force": force_split,
    "paragraphs": lambda text: merged_paragraphs(re.split(r"\n\s*\n|\n", text)),
    "sentences": sentence_pack,
    "cascade": separator_cascade,
    "sentence_windows": sentence_windows,
    "sql": sql_statements,
}


def packed(docs: DataFrame, packer: str | Column) -> DataFrame:
    """doc_id, chunk_index, heading and chunk by one of the PACKERS, or by the one that a column names; texts are cut one by one, in Arrow
    batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, cut in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, got in enumerate(PACKERS[cut](text or "")):
                    heading, chunk = got if isinstance(got, tuple) else (None, got)
                    out.append((doc_id, k, heading, chunk))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_id", "chunk_index", "heading", "chunk"])

    name = F.lit(packer) if isinstance(packer, str) else packer
    return docs.select(F.col("doc_id").cast("long"), "text", name.alias("packer")).mapInArrow(run, CHUNK)


def packer_of(name: str = "path") -> Column:
    """The packer that a file's extension asks for."""
    from textloom.functions.text import extension

    ext = extension(name)
    return F.when(ext == ".md", "markdown").when(ext == ".sql", "sql").when(ext.isin(".docx", ".txt"), "paragraphs").otherwise("force")


def routed(docs: DataFrame, name: str = "path") -> DataFrame:
    """Documents with the packer that their extension asks for."""
    return docs.withColumn("packer", packer_of(name))


def routed_chunks(docs: DataFrame, name: str = "path", marked: str = "cursor") -> DataFrame:
    """Chunks of documents, each by its own packer, in one pass; type is ``marked`` for files whose names begin with it and an underscore, else
    narrative. docs has one row a doc_id."""
    from textloom.functions.text import basename

    types = docs.select(F.col("doc_id").cast("long"), F.when(basename(name).startswith(marked + "_"), marked).otherwise("narrative").alias("type"))
    return packed(docs, packer_of(name)).join(types, "doc_id")


def slide_chunks(slides: DataFrame, most: int = 800) -> DataFrame:
    """Slides (deck, slide, title, has_notes, text) in chunks: deck, slide, title, has_notes, chunk_index, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(slide_pieces(t or "", most)) for t in batch.column(4).to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            places, chunks = pa.array([k for x in found for k in range(len(x))], pa.int32()), pa.array([c for x in found for c in x], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(4)), places, chunks], names=["deck", "slide", "title", "has_notes", "chunk_index", "chunk"])

    return slides.select(F.col("deck").cast("long"), F.col("slide").cast("int"), "title", "has_notes", "text").mapInArrow(run, "deck long, slide int, title string, has_notes boolean, chunk_index int, chunk string")
