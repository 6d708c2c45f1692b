"""WARC archives: written one gzip member a record, and read back sequentially.

Archives lie in the shared folder, one file for each writing task and attempt; the manifest that a write returns names
the files of the attempts that counted. The reader takes a file in chunks, inflates one member at a time, frames the
record by its Content-Length and verifies its digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import common as C

CHUNK = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_MANIFEST = "path string, records long, bytes long"
_RECORDS = "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


class WarcError(ValueError):
    """An archive that is cut off, or whose frame or digest is wrong."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One record, inflated. payload: None for a revisit, which has the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + (payload or b"")
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of each gzip member of a stream, read in chunks."""
    offset, held = 0, b""
    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held:
                held = stream.read(CHUNK)
                if not held:
                    raise WarcError(f"the member at {offset} is cut off")
            try:
                parts.append(inflate.decompress(held))
            except zlib.error as e:
                raise WarcError(f"the member at {offset} is damaged: {e}") from e
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield offset, b"".join(parts)
        offset += used


def _headers(lines: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        elif line:
            name, mark, value = line.partition(":")
            if not mark:
                raise WarcError(f"no named field: {line!r}")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _verified(stated: str | None, data: bytes, what: str) -> str:
    """The base32 SHA-1 of data; an error if the stated digest is another one. Digests that are not SHA-1 are not verified."""
    own = base32_sha1(data)
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and value.upper() != own and value.lower() != hashlib.sha1(data).hexdigest():
        raise WarcError(f"the {what} digest differs")
    return own


def parse(data: bytes) -> dict:
    """The fields of one record, with its frame and those digests verified that it states.

    Records of other writers are read too: names of fields in any case, folded lines, no digests, ids of any form (then
    page_id and refers_to are null) and any type. The payload of an HTTP response or request is what follows its header, of
    any other record its block; a revisit has none, and its size and digest are what it states, else null.
    """
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    fields = _headers(lines)
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    if "warc-block-digest" in fields:
        _verified(fields["warc-block-digest"], block, "block")
    kind, asked = fields["warc-type"].lower(), fields.get("warc-payload-digest")
    web = fields.get("content-type", "").lower().startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if web else (b"", b"", block)
    length = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", http)
    stated = int(length[1]) if length else None
    if kind == "revisit":
        payload, n = None, stated
        digest = asked.partition(":")[2] if asked and asked.lower().startswith("sha1:") else None
    else:
        n, digest = len(payload), _verified(asked, payload, "payload")
        if kind == "response" and stated not in (None, n) and "warc-truncated" not in fields:
            raise WarcError("the payload is not as long as the HTTP header says")
    number = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, ""))) else None
    return {"record_id": fields["warc-record-id"], "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to")}


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest (hex), refers_to for each row of pages.

    Of rows with equal payloads of at least `least` bytes, one with the smallest page_id is the response. Pages travel
    by page, digests without their payload, so a payload that many pages share fills no task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # A null page_id is a key of its own here, so that join and window agree on how rows are dealt and payloads move once.
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    keys = rows.select("key", "digest").distinct()
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    both = rows.join(keys.join(first, "digest"), ["key", "digest"])
    # Of repeated rows of the first page, one is the response.
    both = both.withColumn("turn", F.row_number().over(W.partitionBy("key", "digest").orderBy("url")))
    size = F.octet_length("payload").cast("long")
    again = (size >= least) & F.col("first").isNotNull() & ((F.col("turn") > 1) | ~F.col("page_id").eqNullSafe(F.col("first")))
    return both.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), size.alias("payload_bytes"), "digest", F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 6) -> DataFrame:
    """Write the pages' records into folder (a URI that every executor reaches); returns the manifest path, records, bytes.

    A null html is an empty payload, a null url leaves out the target, a null page_id is written as such and never
    referred to. An empty table gives an empty manifest. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        path = f"{folder}/part-{at.partitionId():06d}-{at.taskAttemptId()}.warc.gz"
        stream, count, size = None, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, n, digest, refers_to = (c[row].as_py() for c in batch.columns)
                data = gzip.compress(record(page_id, url, payload, n, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to), level, mtime=0)
                if stream is None:
                    store, name = fs.FileSystem.from_uri(folder)
                    store.create_dir(name, recursive=True)
                    stream = store.open_output_stream(f"{name}/{path.rpartition('/')[2]}", compression=None)
                stream.write(data)
                count, size = count + 1, size + len(data)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return C.settle(planned(pages, least).mapInArrow(run, _MANIFEST), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column `path`, verified: record_id, page_id, url, payload (null for revisits and where not
    asked for), payload_bytes, payload_digest, record_type, refers_to, path, offset. A damaged archive is an error."""
    names = ["record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"]
    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                out, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for offset, data in members(stream):
                        try:
                            row = parse(data)
                        except (WarcError, KeyError, ValueError) as e:
                            raise WarcError(f"{path}, record at {offset}: {e}") from e
                        if not payloads:
                            row["payload"] = None
                        out.append(row | {"path": path, "offset": offset})
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, types))))
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, types))))

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, _RECORDS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Digest of the archives of all pages, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write(pages, f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first, ('0x' || d) AS x FROM p
), b AS (
  SELECT page_id, octet_length(encode(h)) AS n, first,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(d || '00', 1 + 2 * (i * 5 // 8), 4))::BIGINT) >> (11 - (i * 5) % 8)) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM f
)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
