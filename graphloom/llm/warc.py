"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The writer puts every record into a gzip member of its own, rolls files at a size, and moves a file
to its final name only when it is whole; the manifest of files is itself a written table. The reader
inflates one member after the other in small steps, frames the block by Content-Length and checks
both digests while the bytes pass. Files go through a URI that every executor can open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import frames, materialize, shared_dir

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
STEP = 1 << 16


class WarcError(ValueError):
    """A record that isn't framed or digested as it says."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit if refers_to is given."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Member:
    """The bytes of one gzip member, inflated on demand."""

    def __init__(self, stream: BinaryIO, held: bytes):
        self.stream, self.held, self.out = stream, held, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        self.held = self.held or self.stream.read(STEP)
        if not self.held:
            raise WarcError("a gzip member is cut off")
        self.out += self.inflate.decompress(self.held, STEP)
        self.held = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise WarcError(f"{mark!r} is missing")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise WarcError("a block is shorter than its Content-Length")
            part = bytes(self.out[:n])
            del self.out[: len(part)]
            n -= len(part)
            if part:
                yield part


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in rest)}


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def read_records(stream: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order. Raises WarcError on a wrong frame or digest."""
    held = b""
    while held := held or stream.read(STEP):
        m = _Member(stream, held)
        version, head = _headers(m.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise WarcError(f"no WARC record: {version[:20]!r}")
        left = int(head["content-length"])
        block, payload, http, body, kept = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, []
        open_head = True
        for part in m.take(left):
            block.update(part)
            if open_head:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                open_head, part = False, bytes(http[at + 4 :])
                del http[at:]
            payload.update(part)
            body += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(m.take(4)) != b"\r\n\r\n":
            raise WarcError("a record doesn't end with two line ends")
        while m.more():
            pass
        if m.out:
            raise WarcError("bytes after a record in its member")
        held = m.held
        b32 = lambda h: base64.b32encode(h.digest()).decode()
        claimed = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        if b32(block) != head["warc-block-digest"].removeprefix("sha1:") or not revisit and b32(payload) != claimed:
            raise WarcError(f"a digest is wrong in {head['warc-record-id']}")
        size = int(_headers(bytes(http))[1]["content-length"])
        if not revisit and size != body:
            raise WarcError(f"a payload of {body} bytes is said to have {size}")
        yield {
            "page_id": _page(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": claimed,
            "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
        } | ({"payload": None if revisit else b"".join(kept)} if with_payload else {})


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row of pages below folder; returns the manifest (path, records, bytes).

    Rows with equal payloads of at least min_bytes: the one with the smallest id is a response, the
    others revisit it. A null html is an empty payload; rows that repeat the smallest id are responses
    too, and so are payloads of which no row has an id. Shorter payloads are all responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    # only payloads that occur more than once take part in the join; their table is written first, so
    # that its size is known when the join is planned
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = materialize(firsts.select("digest", "first"), "warc-firsts")
    long = F.octet_length("html") >= min_bytes
    target = F.when(long & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "html", target.alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        out, name, done = None, "", []
        records = size = 0

        def close() -> None:
            nonlocal out
            out.close()
            system.move(f"{top}/.{name}.part", f"{top}/{name}")
            done.append((f"{folder}/{name}", records, size))
            out = None

        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{top}/.{name}.part", compression=None)
                got = record(None if page_id is pd.NA else int(page_id), url, html.encode(), None if refers is pd.NA else int(refers))
                out.write(got)
                records, size = records + 1, size + len(got)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return materialize(frames(rows, run, "path string, records bigint, bytes bigint"), "warc-manifest")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives that manifest (path) lists; one task reads whole files in order."""
    schema = RECORD + (", payload binary" if with_payload else "")
    at_once = 64 if with_payload else 1024

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows = []
                    for r in read_records(stream, with_payload):
                        rows.append(r)
                        if len(rows) == at_once:
                            yield _frame(rows)
                            rows = []
                    if rows:
                        yield _frame(rows)

    def _frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frames(files, run, schema)


def warc_round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write pages as archives in the shared folder and read all of them back: RECORD without url."""
    folder = f"{shared_dir(pages.sparkSession)}/graphloom/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    return read_warc(write_warc(pages, folder, **names)).drop("url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex),
b AS (
  SELECT d.*, f.first_id,
    array_to_string(list_transform(range(8), lambda g:
      array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('{ALPHABET}', 1 + ((CAST('0x' || substr(d.hex, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31)::INT, 1)), '')), '') AS payload_digest
  FROM d JOIN f USING (hex))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
