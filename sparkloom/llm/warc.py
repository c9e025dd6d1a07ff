"""WARC archives: writing captures and assembling transactions.

`write_archives` gives each page a request, a response (or a revisit) and a metadata record, which name their response
through WARC-Concurrent-To. Of pages with equal payloads the one with the largest page_id is the response, the others
revisit it. Records are UTF-8 text and end in two line breaks, so Spark's own text writer makes the files, with its
commit protocol and its reach to any store. `read_records` parses the files by Content-Length; `assemble` joins the
records through their concurrent-to identifiers (also where one leads to another) into one nested row per capture.

Edge cases: null html is an empty payload; a null url is written as urn:page:<id>; line breaks in a url are
percent-encoded; pages without an id are responses and captures of their own by url and payload; rows that repeat a
page_id are captures of their own by payload; rows that repeat both are answers of one capture (all responses, if the
page_id is the payload's largest); an empty table gives no captures; other columns are ignored. Payloads of any length
are kept whole: longer ones have files of fewer records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, stored

END = "\r\n\r\n"
#: Pages of a file by the most bytes of their payloads: files stay below 128 MB, but for single pages. Three records to a page.
FILE_PAGES = ((1 << 18, 500), (1 << 23, 15), (1 << 62, 1))
#: A payload is hot from one part in so many of all pages on.
HOT_KEYS = 1000
READ_BYTES = 1 << 20
DATE = "2026-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public namespace of URLs


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{key}')}>"


def _record(headers: list[tuple[str, str]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block.encode()))]]
    return "\r\n".join(["WARC/1.1", *lines, "", block])


def capture_records(page_id: int | None, url: str | None, html: str, original: int | None) -> list[str]:
    """The page's records without their ends; original: the page that a revisit refers to."""
    payload = html.encode()
    sha1 = sha1_base32(payload)
    key = f"{f'url:{url}' if page_id is None else f'page:{page_id}'}|{sha1}"
    url = f"urn:page:{page_id}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    main, digest = _record_id("response", key), f"sha1:{sha1}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    http = ("Content-Type", "application/http; msgtype=response")
    if original is None:
        answer = _record([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), http], reply + html)
    else:
        refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id("response", f"page:{original}|{sha1}"))]
        answer = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, *refers, ("WARC-Payload-Digest", digest), http], reply)
    request_id = _record_id("request", key)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], "GET / HTTP/1.1\r\n\r\n")
    fields = f"page-id: {'' if page_id is None else page_id}\r\n" + (f"refers-to-page-id: {original}\r\n" if original is not None else "")
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", key)), *common, ("WARC-Concurrent-To", request_id), ("Content-Type", "application/warc-fields")], fields)
    return [request, answer, metadata]


def _write_batches(batches):
    for batch in batches:
        values: list[str] = []
        for page in zip(*(c.to_pylist() for c in batch.columns)):
            values += capture_records(*page)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


def _with_digest(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return p.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))


def payloads(pages: DataFrame) -> DataFrame:
    """digest, largest (page_id), n, bytes of each payload, read from pages once."""
    rows = _with_digest(pages).groupBy("digest")
    return stored(rows.agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("bytes")), "payloads")


def with_originals(pages: DataFrame, known: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, original: the largest page_id of those with an equal payload, null for that page itself; known: payloads(pages)."""
    n = known.agg(F.sum("n")).first()[0] or 0
    shared = known.filter((F.col("n") > 1) & (F.col("bytes") >= min_bytes))
    hot = shared.filter(F.col("n") > n / HOT_KEYS).select("digest", "largest")
    rows = spread_join(_with_digest(pages), shared.select("digest", "largest"), "digest", hot)
    return rows.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("original"))


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Writes the WARC files of pages (page_id, url, html) to the folder out, compressed."""
    known = payloads(pages)
    longest = known.agg(F.max("bytes")).first()[0] or 0
    rows, least = with_originals(pages, known, min_bytes), 0
    for most, of_file in FILE_PAGES:
        some = rows.filter(F.octet_length("html").between(least, most)) if longest > FILE_PAGES[0][0] else rows
        map_arrow(some, _write_batches, "value string").write.mode("append").option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", 3 * of_file).text(out)
        least = most + 1
        if longest <= most:
            break


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def unpacked(data: bytes):
    """The bytes of a file, whose gzip members (if any) are unpacked one after another, in parts of bounded size."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[at : at + READ_BYTES]) for at in range(0, len(data), READ_BYTES))
        return
    at, d, left = 0, zlib.decompressobj(31), b""
    while left or at < len(data):
        if not left:
            left = bytes(view[at : at + READ_BYTES])
            at += len(left)
        yield d.decompress(left, 4 * READ_BYTES)
        left = d.unconsumed_tail
        if d.eof:
            left, d = d.unused_data, zlib.decompressobj(31)


def parse(parts):
    """(headers, block) of each record of bytes, whole or in parts; Content-Length alone says where a block ends."""
    source = iter([parts] if isinstance(parts, bytes) else parts)
    held, at, looked = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, looked
        got = next(source, None)
        if got is None:
            return False
        del held[:at]
        looked, at = max(0, looked - at), 0
        held.extend(got)
        return True

    while True:
        start = held.find(b"WARC/", at)
        if start < 0:
            at = max(at, len(held) - 4)
            if not more():
                return
            continue
        at = looked = start
        while (stop := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(at, len(held) - 3)
            if not more():
                raise ValueError("an archive ends inside a record")
        headers = dict(x.split(": ", 1) for x in held[at:stop].decode().split("\r\n")[1:])
        length = int(headers["Content-Length"])
        size = stop + 4 - at
        while len(held) - at < size + length:
            if not more():
                raise ValueError("an archive ends inside a record")
        block = bytes(memoryview(held)[at + size : at + size + length])
        yield headers, block
        at += size + length


def _parse_batches(payloads: bool):
    def one(headers, block):
        kind = headers["WARC-Type"]
        digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        n, payload, fields = None, None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                n, payload = len(body), body
                if sha1_base32(body) != digest:
                    raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not agree")
            else:
                n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        elif kind == "metadata":
            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
        return (headers["WARC-Record-ID"], kind, headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), n, digest, fields, payload if payloads else None)

    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(unpacked(content.as_py())):
                    rows.append(one(headers, block))
                    size += len(block) if payloads else 0
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in path. The digest of every response is checked against its payload."""
    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), _parse_batches(payloads), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, requests, answers (responses and revisits) and metadata.

    A record belongs to the record that its concurrent-to names, or to that one's own, if it has one.
    """
    links = records.filter("concurrent_to is not null").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("root")).distinct()
    tied = records.join(links, records.concurrent_to == links.via, "left")
    row = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    pick = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), row))
    capture = F.coalesce("root", "concurrent_to", "record_id").alias("capture_id")
    return tied.groupBy(capture).agg(pick("request").alias("requests"), pick("response", "revisit").alias("answers"), pick("metadata").alias("metadata"))


def capture_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each answer."""
    field = lambda k: F.get(F.col("metadata.fields"), 0)[k]
    rows = captures.select(field("page-id").alias("page"), F.transform("metadata.fields", lambda f: f["refers-to-page-id"]).alias("to"), F.explode("answers").alias("a"))
    refers = F.when(F.col("a.type") == "revisit", F.array_max("to").cast("long"))
    return rows.select(F.nullif("page", F.lit("")).cast("long").alias("page_id"), F.col("a.payload_bytes").alias("payload_bytes"), F.col("a.payload_digest").alias("payload_digest"), F.col("a.type").alias("record_type"), refers.alias("refers_to"))
