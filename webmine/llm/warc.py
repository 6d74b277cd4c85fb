"""WARC archives: one gzip member per record, written by the tasks and read back sequentially.

Writing: records of equal payloads share one ``response`` (the smallest page_id); the others become ``revisit``
records without the payload. Each task streams its records into archives of bounded size in a shared folder. An
archive is written under a name of its task attempt and then moved to a name that the partition alone decides, so a
task that runs twice leaves one archive. Reading: a task takes an archive as a stream, inflates member by member,
cuts the record by its Content-Length and verifies block and payload digests; nothing but one record is held.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member."""
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": str(refers_to) if revisit else None,
        "X-Payload-Length": str(len(payload)),
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None)
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(b"WARC/1.1\r\n" + lines + CRLF + block + CRLF + CRLF) + gzip.flush()


def gzip_members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated members of a gzip file, one by one."""
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not rest and not (rest := stream.read(READ_BYTES)):
                raise ValueError("the archive ends inside a gzip member")
            parts.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(parts)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a member that holds one record; its block digest is verified."""
    head, found, rest = member.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record at the start of a gzip member")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != CRLF + CRLF:
        raise ValueError(f"record {fields.get('warc-record-id')}: Content-Length {length} doesn't frame its block")
    if fields.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong block digest")
    return fields, block


def read_archive(stream: BinaryIO) -> Iterator[dict]:
    """A dict per record: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` (None for
    revisits). Raises ValueError at framing faults and wrong digests; nothing is skipped."""
    for member in gzip_members(stream):
        fields, block = parse_record(member)
        payload = block.partition(CRLF + CRLF)[2]
        digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
        if not revisit and (digest != sha1_base32(payload) or len(payload) != int(fields["x-payload-length"])):
            raise ValueError(f"record {fields.get('warc-record-id')}: wrong payload digest")
        number = {k: int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
        yield {
            "page_id": number["x-page-id"], "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": number["x-refers-to-page-id"], "payload_bytes": int(fields["x-payload-length"]),
            "payload_digest": digest, "payload": None if revisit else payload,
        }


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: refers_to is the smallest page_id with an equal payload, NULL for that
    page itself, for pages without equals and for payloads under ``min_bytes``.

    Payloads are equal if SHA-256 and length are. NULL html: the empty payload. Rows that share the smallest page_id
    are all responses; a group in which no row has an id has only responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("__key", F.unhex(F.sha2("payload", 256)))
    # Only payloads that occur more than once; the first of each group comes from a partial aggregate.
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("__key").agg(
        F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    repeated = groups.where("__n > 1 and __first is not null").select("__key", "__first")
    joined = rows.join(repeated, "__key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (of ``with_revisits``) as archives below ``folder`` (a URI all executors share) and return
    the manifest ``(archive, records, bytes)``, checkpointed: it is complete when the call returns."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        made, out, own, n, size = 0, None, "", 0, 0

        def close() -> pd.DataFrame:
            out.close()
            name = f"part-{task.partitionId():06d}-{made:04d}.warc.gz"
            files.move(own, f"{root}/{name}")
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                page, first = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                data = encode_record(page, url if isinstance(url, str) else None, bytes(payload), first is not None, first, date)
                if out is None:
                    own, n, size = f"{root}/.writing-{task.taskAttemptId()}-{made}", 0, 0
                    out = files.open_output_stream(own, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out, made = None, made + 1
        if out is not None:
            yield close()

    exact = records.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return cut_lineage(exact.mapInPandas(write, "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` (column ``archive``) names; see ``read_archive``."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for archive in batch["archive"]:
                files, path = fs.FileSystem.from_uri(archive)
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append(tuple(r[c] for c in names))
                        held += 200 + with_payload * len(r["payload"] or b"")
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=names, dtype=object)
        return f.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(tasks, "archive").mapInPandas(read, schema + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the manifest. ``folder``: a URI that all
    executors share, by default a new one below ``spark.checkpoint.dir``. An empty table makes no archive."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_archives(with_revisits(pages, min_bytes), folder)
