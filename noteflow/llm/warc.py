"""WARC archives as a chunked record table.

Writing: each page becomes a WARC/1.1 record; payloads longer than a segment go
on in ``continuation`` records, so no written row holds more than one segment.
Spark's text writer lays records end to end (the record separator is its line
separator) in gzip files, which gives its commit protocol to the archives.

Reading: tasks stream the archive files and give rows of (record identifier,
chunk number), each with the digest and length of the payload so far. A reader
holds one chunk and one open digest per unfinished record, never a record.

Of equal payloads of at least ``REVISIT_BYTES`` the page with the largest id is
the response and the others revisit it (no payload stored). Null html is an
empty payload; null ids count as smaller than all others; a group whose ids are
all null, and rows that repeat the id of the response, are all responses. A
null url leaves the target header out; line breaks in urls become ``%0A``. An
empty table gives an archive without records. Columns other than page_id, url
and html are not read, and may have any names.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm.store import lookup, written

SEGMENT_BYTES = 4 << 20
CHUNK_BYTES = 64 << 10
REVISIT_BYTES = 1000
#: Most records of an archive file; the files of a task follow each other.
RECORDS_PER_FILE = 8192
DATE = "2024-01-01T00:00:00Z"
CHUNK_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no long, "
    "data binary, bytes_so_far long, sha1_so_far string, payload_bytes long, payload_digest string, last boolean"
)
FLUSH_BYTES = 4 << 20


def _record_id(page_id: str) -> str:
    return f"concat('<urn:page:', coalesce(cast({page_id} AS string), 'null'), '>')"


def planned_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, response_id (null: this page is a response).

    Only slim rows are shuffled: the digests that pages share are looked up on
    the map side, all of them where they are few, the frequent ones otherwise.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest")
    shared = shared.agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(pages.sparkSession, shared, "shared_digests")
    other = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    rows = lookup(pages.sparkSession, rows, shared, "digest", stable=True)
    return rows.withColumn("response_id", F.when(other, F.col("winner"))).drop("winner")


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one WARC record (or a chain of segments) per page into ``folder``."""
    http = (
        "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', n_bytes, '\\r\\n\\r\\n')"
    )
    rows = planned_records(pages).withColumn("http", F.expr(http))
    stored = F.when(F.col("response_id").isNull(), F.col("payload")).otherwise(F.lit(b""))
    rows = rows.withColumn("stored", stored).withColumn("n_stored", F.octet_length(stored))
    rows = rows.withColumn("n", F.expr(f"greatest(0, (n_stored - 1) div {segment_bytes}) + 1")).withColumn("i", F.expr("explode(sequence(0L, n - 1))"))
    rows = rows.withColumn("piece", F.expr(f"substring(stored, cast(i * {segment_bytes} + 1 AS int), {segment_bytes})"))
    head = f"""concat('WARC/1.1\\r\\nWARC-Type: ',
        CASE WHEN i > 0 THEN 'continuation' WHEN response_id IS NULL THEN 'response' ELSE 'revisit' END,
        '\\r\\nWARC-Record-ID: ', CASE WHEN i = 0 THEN {_record_id('page_id')} ELSE concat('<urn:segment:', coalesce(cast(page_id AS string), 'null'), ':', i + 1, '>') END,
        '\\r\\nWARC-Date: {DATE}',
        coalesce(concat('\\r\\nWARC-Target-URI: ', regexp_replace(url, '[\\\\r\\\\n]', '%0A')), ''),
        CASE WHEN i = 0 THEN concat('\\r\\nWARC-Payload-Digest: sha1:', digest) ELSE '' END,
        CASE WHEN n > 1 THEN concat('\\r\\nWARC-Segment-Number: ', i + 1) ELSE '' END,
        CASE WHEN i > 0 THEN concat('\\r\\nWARC-Segment-Origin-ID: ', {_record_id('page_id')}) ELSE '' END,
        CASE WHEN i > 0 AND i = n - 1 THEN concat('\\r\\nWARC-Segment-Total-Length: ', n_stored + octet_length(http)) ELSE '' END,
        coalesce(concat('\\r\\nWARC-Refers-To: ', CASE WHEN response_id IS NOT NULL THEN {_record_id('response_id')} END,
            '\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'), ''),
        CASE WHEN i = 0 THEN '\\r\\nContent-Type: application/http; msgtype=response' ELSE '' END,
        '\\r\\nContent-Length: ', octet_length(piece) + CASE WHEN i = 0 THEN octet_length(http) ELSE 0 END,
        '\\r\\n\\r\\n', CASE WHEN i = 0 THEN http ELSE '' END)"""
    record = F.concat(F.encode(F.expr(head), "UTF-8"), F.col("piece")).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def open_uri(uri: str) -> BinaryIO:
    """Open a file of the shared folder for streaming, local or in a remote store."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path)


def _headers(stream: BinaryIO, left: float = float("inf"), first: str = "") -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, bytes read; at most ``left`` bytes. Lines may have any length."""
    fields, used = {}, 0
    while used < left:
        line = stream.readline() if left == float("inf") else stream.readline(int(left) - used)
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not first:
            first = line.decode("utf-8", "replace").strip()
        elif colon:
            fields[name.strip().lower()] = value.strip()
    return first, fields, used


def stream_chunks(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> Iterator[tuple]:
    """Rows of ``CHUNK_SCHEMA`` of one archive; segments of a record may stand between other records."""
    unfinished: dict[str, list] = {}
    while True:
        first = stream.readline()
        if not first:
            break
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        _, fields, _ = _headers(stream, first="WARC")
        kind, left = fields["warc-type"], int(fields["content-length"])
        origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
        if kind == "continuation":
            state = unfinished.pop(origin)
        else:
            n_bytes = None
            if fields.get("content-type", "").startswith("application/http"):
                _, http, used = _headers(stream, left)
                left -= used
                n_bytes = int(http["content-length"]) if "content-length" in http else None
            digest = fields.get("warc-payload-digest", "").partition(":")[2]
            state = [kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), 0, 0, hashlib.sha1(), n_bytes, digest]
        ends = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
        while True:
            data = stream.read(min(left, chunk_bytes))
            left -= len(data)
            if left and not data:
                raise ValueError(f"{origin} is cut short")
            state[4] += len(data)
            state[5].update(data)
            last = ends and not left
            yield (
                origin, state[0], state[1], state[2], state[3], data if keep_data else None, state[4], state[5].hexdigest(), state[6], state[7], last,
            )
            state[3] += 1
            if not left:
                break
        if not ends:
            unfinished[origin] = state
    if unfinished:
        raise ValueError(f"segments of {next(iter(unfinished))} are missing")


def read_chunks(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> DataFrame:
    """The chunked record table of all archives in ``folder``."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        held, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                with open_uri(path) as raw, gzip.open(raw) if path.endswith(".gz") else raw as stream:
                    for row in stream_chunks(stream, chunk_bytes, keep_data):
                        held.append(row)
                        size += 300 + len(row[5] or b"")
                        if size >= FLUSH_BYTES:
                            yield pd.DataFrame(held, columns=names).astype({"payload_bytes": "Int64"})
                            held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.mapInPandas(chunks, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: what the streamed bytes add up to, checked against the headers.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    number = r"^<urn:page:(-?\d+)>$"
    page = lambda c: F.when(F.col(c).rlike(number), F.regexp_extract(c, number, 1).cast("long"))
    revisit = F.col("record_type") == "revisit"
    sound = revisit | ((F.col("sha1_so_far") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes")))
    return chunks.where("last").select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(F.isnull(F.when(~sound, F.raise_error(F.concat(F.lit("digest mismatch in "), "record_id")))), F.when(revisit, F.col("payload_digest")).otherwise(F.col("sha1_so_far"))).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
