"""WARC archives: writing, reading and assembling transactions (operator 10).

Each page becomes three records, a request, a response (or a revisit of an equal payload) and a metadata record, the
first and the last concurrent to the second.  Reading yields one row per record and checks payload digests against the
bytes; :func:`assemble` joins the records of a transaction through WARC-Concurrent-To and gives one nested row per capture;
:func:`resolve` finds the captures that revisits refer to, through the standard headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 26
RECORD = "record_id string, kind string, concurrent_to string, target_uri string, date string, payload_digest string, refers_to string, refers_to_uri string, refers_to_date string, page_id long, payload_bytes long, block binary"
PAGES = uuid.UUID("8f1d6c1e-54f5-4f0e-9b53-0b6a4b1c7f11")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """A record whose payload doesn't have the digest in its header."""


def page_urn(page_id: int, digest: str) -> str:
    """The record id of a page's capture, from its id and payload."""
    return f"<urn:uuid:{uuid.uuid5(PAGES, f'{page_id} {digest}')}>"


def bare_digest(value: str | None, payload: bytes | None) -> str | None:
    """A payload digest as bare hex SHA-256: computed from the payload and held against the header, or the header's own.

    Headers may have any algorithm of hashlib, in hex or base 32; one of another algorithm is kept as it stands for revisits.
    """
    name, _, named = (value or "").partition(":")
    name = name.lower().replace("-", "")
    if payload is None:
        return (named.lower() if name == "sha256" and len(named) == 64 else value) or None
    if named and name in hashlib.algorithms_guaranteed and not name.startswith("shake"):
        found = hashlib.new(name, payload).digest()
        if named.lower() != found.hex() and named.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("="):
            raise Damaged(f"payload digest is {found.hex()}, header has {value}")
    return hashlib.sha256(payload).hexdigest()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; no time stamp, so equal records are equal bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def _clean(value: str) -> str:
    """Header values hold no line ends."""
    return " ".join(value.splitlines()).strip()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an uncompressed stream; one block is in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("truncated record")
        yield head, block


def page_records(page_id: int | None, url: str, payload: bytes, digest: str, own: str, first: tuple[str | None, str] | None) -> Iterator[bytes]:
    """A capture's three records.  ``first``: record id (None if it isn't unique) and URL of the capture that this one revisits."""
    page = [("X-Page-Id", str(page_id))] if page_id is not None else []
    common_ = [("WARC-Date", DATE), ("WARC-Target-URI", url or "about:blank")]
    host, _, rest = (url or "").partition("://")[2].partition("/")
    of = lambda kind: f"<urn:uuid:{uuid.uuid5(PAGES, kind + own)}>"
    yield record([("WARC-Type", "request"), ("WARC-Record-ID", of("request")), ("WARC-Concurrent-To", own), *common_, ("Content-Type", "application/http; msgtype=request")], f"GET /{_clean(rest)} HTTP/1.1\r\nHost: {_clean(host)}\r\n\r\n".encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    what = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), *page]
    if first is None:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common_, *what], http + payload)
    else:
        back = [("WARC-Refers-To", first[0])] if first[0] else []
        back += [("WARC-Refers-To-Target-URI", first[1] or "about:blank"), ("WARC-Refers-To-Date", DATE)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common_, *what, ("WARC-Profile", REVISIT), *back], http)
    yield record([("WARC-Type", "metadata"), ("WARC-Record-ID", of("metadata")), ("WARC-Concurrent-To", own), *common_, ("Content-Type", "application/warc-fields")], f"payload-bytes: {len(payload)}\r\n".encode())


def write_archives(pages: DataFrame, folder: str, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as .warc.gz files: one row per file, ``file, n_records``.

    * payload: the html in UTF-8, null html and empty html no bytes;
    * of equal payloads of at least ``least`` bytes the smallest page id is a response, the others revisit it; repeated
      rows of that smallest id are all responses, and so is a row without id;
    * only digests with more than one page are joined back, hot ones dealt to many tasks; the least id is found by partial
      aggregates;
    * record ids follow from page id and payload where that is unique, so a revisit can name the capture it refers to;
      where the smallest id's row is repeated, it names URL and date alone.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = F.octet_length("payload") >= least
    some = rows.filter(big).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("times"), F.min("url").alias("url"))
    lowest = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "times", "url"))).alias("least")
    first = common.materialize(some.groupBy("digest").agg(lowest, F.sum("times").alias("n")).filter("n > 1 AND least IS NOT NULL"), "digests")
    least_of = lambda k: F.when(F.octet_length("payload") >= least, F.col("least")[k])
    dealt = common.join_counted(rows, first, ["digest"], ["page_id", "url"], how="left")
    dealt = dealt.select("page_id", "url", "payload", "digest", least_of("page_id").alias("first"), least_of("times").alias("times"), least_of("url").alias("first_url"))

    def write(batches):
        import pyarrow as pa

        fs, where = common.open_fs(folder)
        fs.create_dir(where)
        out, done, size, n = None, [], 0, 0
        for b in batches:
            for p, u, body, digest, first, times, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{where}/{name}", compression=None)
                back = None if first is None or p is None or p <= first else (page_urn(first, digest) if times == 1 else None, first_url or "")
                named = len(body) >= least and p is not None and (first is None or (p == first and times == 1))
                for r in page_records(p, u or "", body, digest, page_urn(p, digest) if named else f"<urn:uuid:{uuid.uuid4()}>", back):
                    out.write(r)
                    size, n = size + len(r), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["file", "n_records"])

    return common.materialize(dealt.mapInArrow(write, "file string, n_records long"), "archives")


def read_archives(files: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """One row per record of the files (schema ``RECORD``); ``blocks=False`` leaves the blocks null.

    ``payload_bytes`` is a response's bytes after its HTTP head, and for a revisit the length that its HTTP head names.
    ``payload_digest`` is the SHA-256 of a response's bytes as read; one that its header contradicts raises ``Damaged``.
    """
    n = max(1, files.count())

    def read(batches):
        import pyarrow as pa

        fs, where = common.open_fs(folder)
        for b in batches:
            for name in b["file"].to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{where}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as f:
                    for h, block in records(f):
                        kind, http = h["warc-type"], h.get("content-type", "").startswith("application/http")
                        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
                        size = len(body) if kind == "response" else None
                        if kind == "revisit":
                            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                        page = h.get("x-page-id")
                        digest = bare_digest(h.get("warc-payload-digest"), body if kind == "response" else None)
                        rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, h.get("warc-refers-to"), h.get("warc-refers-to-target-uri"), h.get("warc-refers-to-date"), None if page is None else int(page), size, block if blocks else None))
                        held += len(block) if blocks else 0
                        if len(rows) == 5000 or held > 1 << 24:
                            yield batch(pa, rows)
                            rows, held = [], 0
                if rows:
                    yield batch(pa, rows)

    def batch(pa, rows):
        types = [pa.string()] * 9 + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return files.select("file").repartition(n).mapInArrow(read, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, main, requests, metadata``.

    A record belongs to the capture that it is concurrent to, or to itself.  ``main`` is the response or revisit (null if
    the archive has only its companions; the least id of several), ``requests`` and ``metadata`` hold the companions in
    the order of their record ids.  The size of a row is that of one transaction.
    """
    fields = F.struct(*[c for c in rows.columns if c not in ("kind", "concurrent_to")], "kind")
    own = F.col("kind").isin("response", "revisit")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, fields)))
    return rows.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(F.min_by(F.when(own, fields), F.when(own, F.col("record_id"))).alias("main"), of("request").alias("requests"), of("metadata").alias("metadata"))


def resolve(captures: DataFrame) -> DataFrame:
    """``captures`` (a written table, of :func:`assemble`) with ``refers_to_page``, the page id of the capture a revisit refers to.

    A revisit names it by record id, or else by URL, date and digest (the least page id of several); null where the
    archives don't have it.  What is looked up are the named captures alone; one that many revisits name is dealt to many
    tasks.
    """
    column = common.fresh("_ref", captures)
    at = lambda *c: F.concat_ws(" ", *(F.coalesce(F.col(f"main.{x}"), F.lit("-")) for x in c))
    revisit = F.col("main.kind") == "revisit"
    named = captures.withColumn(column, F.when(revisit, F.coalesce("main.refers_to", at("refers_to_uri", "refers_to_date", "payload_digest"))))
    counts = named.filter(f"`{column}` IS NOT NULL").groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    found = captures.filter("main.kind = 'response'").select(F.explode(F.array("main.record_id", at("target_uri", "date", "payload_digest"))).alias(column), "main.page_id")
    found = found.groupBy(column).agg(F.min("page_id").alias("refers_to_page"))
    found = common.materialize(counts.join(found, column).select(column, "n", "refers_to_page"), "referred")
    return common.join_counted(named, found, [column], ["capture_id"], how="left").drop(column, "n")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    files = write_archives(common.table(spark, sf_dir, "pages"), folder)
    captures = resolve(common.materialize(assemble(read_archives(files, folder, blocks=False)), "captures"))
    return captures.select("main.page_id", "main.payload_bytes", "main.payload_digest", F.col("main.kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to,
       CAST(1 AS INTEGER) AS n_requests, CAST(1 AS INTEGER) AS n_metadata
FROM f
"""
