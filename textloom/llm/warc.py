"""Web archives of individually compressed records that share a Zstandard dictionary.

An archive file is a skippable frame that holds the dictionary (magic number 0x184D2A5D), then one Zstandard frame for
each record, compressed with that dictionary, so that any record can be read by itself. The first record is a warcinfo.
The dictionary is built from the file's first records, a bounded number of them and of their bytes (``SAMPLES``,
``SAMPLE_BYTES``); those are held until it is there, all others go from the reader of the table straight into the file.

Writing tasks take rows as they come and close a file at ``per_file`` records or ``FILE_BYTES``. A task writes under names that only its
attempt has and reports a file when it is whole; readers are given the reported files, so a lost or repeated task
leaves no half record in the archive. Files go through pyarrow's file systems to the shared folder, and come back
through Spark's own binary reader, a file a row and a bounded number of bytes a batch.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the others
are revisits that name its record (WARC-Refers-To). The groups are settled by partial aggregation over digests, so a payload that a
third of all pages share costs no task more than others. The report takes lengths and digests from what was read back; a revisit has
those of the response that it names.

Defined cases: null html is an empty payload; null page_id sorts after every other; of repeated rows with one page_id the
first read is the response and the others revisit that page_id, and each has a record id of its own; very long pages make a file larger
by one record; an empty table writes no file; only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import new_folder, written

DICTIONARY_MAGIC = 0x184D2A5D
LEAST_BYTES = 100
RECORDS_PER_FILE, FILE_BYTES = 4000, 32 << 20
SAMPLES, SAMPLE_BYTES = 256, 8 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of payloads that a reader gives out at once, and manifests and lists of revisits that are broadcast; more are joined by shuffle.
BATCH_BYTES = 16 << 20
BROADCAST_ROWS = 1 << 17
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INFO = b"software: textloom\r\nformat: WARC File Format 1.1\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to string, digest string, payload binary"


def record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{row}')}>"


def _record(kind: str, own: str, heads: dict, block: bytes) -> bytes:
    heads = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": DATE} | heads | {"Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def info_record() -> bytes:
    return _record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", {"Content-Type": "application/warc-fields"}, INFO)


def record_bytes(own: str, page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record: a response, or a revisit of the record ``refers_to``, which has the HTTP headers of its page and no payload."""
    heads = {"WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        heads["X-Page-Id"] = page_id
    if refers_to is not None:
        heads |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to}
    return _record("response" if refers_to is None else "revisit", own, heads, HTTP + payload if refers_to is None else HTTP)


def parse_record(record: bytes) -> tuple:
    """record_id, page_id, url, record_type, refers_to, digest, payload (null but in a response)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    heads = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(heads["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if heads["WARC-Type"] == "response" else None
    page_id = int(heads["X-Page-Id"]) if "X-Page-Id" in heads else None
    digest = heads.get("WARC-Payload-Digest", "").partition(":")[2]
    return heads["WARC-Record-ID"], page_id, heads.get("WARC-Target-URI"), heads["WARC-Type"], heads.get("WARC-Refers-To"), digest, payload


def archive_frames(records: Iterator[bytes], size: int = DICTIONARY_BYTES, level: int = 3) -> Iterator[bytes]:
    """The file's parts: the dictionary in a skippable frame, then a frame for each record. Only the samples are held."""
    records, held = iter(records), []
    for record in records:
        held.append(record)
        if len(held) >= SAMPLES or sum(map(len, held)) > SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(min(size, max(1024, sum(map(len, held)) // 8)), held)
    except zstandard.ZstdError:  # too few or too small records to train on: their own bytes serve
        dictionary = zstandard.ZstdCompressionDict(b"".join(held)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    inner = dictionary.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(inner)) + inner
    yield from map(press.compress, held)
    held.clear()
    yield from map(press.compress, records)


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of a file, each from its own frame."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    inner = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if inner[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(inner, dict_type=kind))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        frame = expand.decompressobj()
        yield frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]


def _writer(folder: str, run: str, per_file: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(6))))
        out: list[tuple[str, int, int]] = []
        row = next(rows, None)
        while row is not None:
            count = size = 0

            def records() -> Iterator[bytes]:
                nonlocal row, count, size
                yield info_record()
                while row is not None and count < per_file and size < file_bytes:
                    at, page_id, url, html, digest, response = row
                    payload = html.encode()
                    count, size = count + 1, size + len(payload)
                    row = next(rows, None)
                    yield record_bytes(record_id(run, at), page_id, url, payload, digest, None if response is None else record_id(run, response))

            name, total = f"{uuid.uuid4().hex}.warc.zst", 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                for part in archive_frames(records()):
                    total += f.write(part)
            out.append((f"{folder}/{name}", count, total))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) and returns their manifest."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "url", html.alias("html"))
    # rows are numbered once, as they are written: another scan of pages may number them anew; the passes that settle the groups read no html
    rows = written(rows.select("*", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest")), "warc-rows")
    large = rows.where(F.col("size") >= least).select("row", "page_id", "digest")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("row"))
    heads = large.groupBy("digest").agg(F.min(order).alias("head"), F.count("*").alias("copies")).where("copies > 1").select("digest", F.col("head.row").alias("response"))
    revisits = written(large.join(heads, "digest").where("row != response").select("row", "response"), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    dealt = rows.join(revisits, "row", "left").select("row", "page_id", "url", "html", "digest", "response")
    return written(dealt.mapInArrow(_writer(folder, uuid.uuid4().hex, per_file, file_bytes), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in a manifest."""
    spark = manifest.sparkSession
    found = [r.folder for r in manifest.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect()]  # one or a few folders
    if not found:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").load(found)
    own = manifest.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    listed = files.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = [c.split()[0] for c in RECORD.split(", ")]
        told = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for record in archive_records(data.as_py()):
                    out.append(parse_record(record))
                    size += len(record)
                    if size > BATCH_BYTES:
                        yield told(out)
                        out, size = [], 0
                if out:
                    yield told(out)

    return listed.select("content").mapInArrow(read, RECORD)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back, and reports each record; lengths and digests are taken anew from what was read."""
    records = read_archives(write_archives(pages)).where("record_type <> 'warcinfo'")
    read = written(records.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"), "record_type", "refers_to"), "warc-read")
    told = ("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "record_type")
    responses = read.where("record_type = 'response'").select(*told, F.lit(None).cast("long").alias("refers_to"))
    named = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("named"), "bytes", "sha256")
    revisits = read.where("record_type = 'revisit'").drop("bytes", "sha256").join(named, "refers_to", "left").drop("refers_to")
    return responses.unionByName(revisits.select(*told, F.col("named").alias("refers_to")))
