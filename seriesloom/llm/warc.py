"""WARC archives: write whole-file gzip, normalise to a gzip member for each record, index, read back.

Spark's text writer with gzip makes the monolithic archives: every record is a string that ends with
CRLF CRLF, the line separator. The normaliser inflates a file's stream once, in pieces, rewrites each
record as a member of its own, and writes a sidecar index of offsets, which is what readers seek by.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch, delete

CRLF = "\r\n"
END = b"\r\n\r\n"
PIECE = 1 << 20
#: Payload bytes aimed at for an archive, well below what a task holds.
ARCHIVE_BYTES = 16 << 20
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the UTF-8 bytes: 20 bits, five hex digits, make four base-32 digits."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def with_record_types(pages: DataFrame, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Digests and record types: of equal payloads of ``min_bytes`` or more, the largest page_id is the response.

    Rows that repeat this page_id are responses as well; a null page_id refers to the largest, and is a
    response only if no equal payload has an id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    last = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last_page"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    if scratch:  # a written table has a known size: a small one is broadcast, and payloads are not shuffled
        last = scratch.table(last, "repeated")
    rows = rows.join(last, "payload_digest", "left")
    revisit = F.col("last_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_page"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("last_page"))).drop("last_page")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def warc_records(rows: DataFrame) -> DataFrame:
    """Each row as the text of a record, without the closing CRLF CRLF: column ``value``."""
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    value = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    return rows.select(value.alias("value"))


def write_monolithic(records: DataFrame, path: str, most_records: int) -> None:
    """Whole-file gzip archives of at most ``most_records`` records."""
    records.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most_records).text(path)


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with their CRLF CRLF, of inflated pieces; holds one record at a time."""
    hold = bytearray()
    need = None
    for piece in stream:
        hold += piece
        while True:
            if need is None:
                at = hold.find(END)
                if at < 0:
                    break
                length = next((int(x.split(b":", 1)[1]) for x in bytes(hold[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                need = at + 4 + length + 4
            if len(hold) < need:
                break
            yield bytes(hold[:need])
            del hold[:need]
            need = None
    if hold.strip():
        raise ValueError(f"{len(hold)} bytes follow the last whole record")


def inflate(data: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one member or many."""
    view = memoryview(data)
    engine = zlib.decompressobj(31)
    at = 0
    while at < len(view):
        part = bytes(view[at : at + piece])
        at += len(part)
        while part:
            out = engine.decompress(part, piece)
            if out:
                yield out
            if engine.eof:
                part, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                part = engine.unconsumed_tail


def member(record: bytes, level: int = 6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _normalise(target: str):
    """Rewrite each monolithic archive; the index file appears last, so a rerun of a task replaces whole files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(target)
        for frame in frames:
            done = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = hashlib.sha1(path.encode()).hexdigest()[:16]
                trial = f"{root}/_{name}-{uuid.uuid4().hex}"
                offset, index = 0, []
                with store.open_output_stream(trial + ".warc.gz", compression=None) as out:
                    for record in records_of(inflate(content)):
                        packed = member(record)
                        index.append(json.dumps({"file": f"{name}.warc.gz", "offset": offset, "length": len(packed)}))
                        out.write(packed)
                        offset += len(packed)
                with store.open_output_stream(trial + ".cdxj", compression=None) as out:
                    out.write("".join(x + "\n" for x in index).encode())
                store.move(trial + ".warc.gz", f"{root}/{name}.warc.gz")
                store.move(trial + ".cdxj", f"{root}/{name}.cdxj")
                done.append((path, f"{name}.warc.gz", len(index), offset))
            yield pd.DataFrame(done, columns=["source", "file", "records", "bytes"])

    return run


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise the ``*.gz`` archives under ``source`` into ``target``; a row for each: ``source, file, records, bytes``.

    A task holds one compressed file and one record. ``target`` must be on a file system that
    executors share. Runs at once, not lazily.
    """
    store, root = _open(target)
    store.create_dir(root, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    return files.mapInPandas(_normalise(target), "source string, file string, records long, bytes long")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and the payload: the block after its HTTP head."""
    head, _, rest = record.partition(END)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(headers.get("content-length", 0))]
    return headers, block.partition(END)[2]


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _read(target: str):
    """Seek each indexed member, inflate it alone, and check the payload of responses against the digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(target)
        files: dict[str, object] = {}
        for frame in frames:
            rows = []
            for line in frame["value"]:
                at = json.loads(line)
                if at["file"] not in files:
                    for old in files.values():
                        old.close()
                    files = {at["file"]: store.open_input_file(f"{root}/{at['file']}")}
                files[at["file"]].seek(at["offset"])
                record = zlib.decompress(files[at["file"]].read(at["length"]), 31)
                headers, payload = parse_record(record)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                rows.append((_page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to"))))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
        for old in files.values():
            old.close()

    return run


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """All records of the normalised archives under ``target`` by their sidecar indexes."""
    index = spark.read.option("pathGlobFilter", "*.cdxj").schema("value string").text(target)
    return index.mapInPandas(_read(target), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC, normalise, and read back: a row for each input row.

    Columns ``page_id, payload_bytes, payload_digest, record_type, refers_to``, see ``with_record_types``.
    A null html is an empty payload; a null url an empty target; a null id is written as ``none``.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    rows = with_record_types(pages, min_bytes, scratch)
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    raw, target = scratch.path("monolithic"), scratch.path("normalised")
    write_monolithic(warc_records(rows), raw, max(1, int(ARCHIVE_BYTES / (mean + 1024))))
    normalise(spark, raw, target).agg(F.sum("records")).first()
    delete(spark, raw)
    return read_archives(spark, target)
