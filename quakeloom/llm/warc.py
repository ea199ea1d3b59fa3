"""WARC archives: writing pages with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader deals byte ranges of the files to tasks. A task scans its range
for gzip's magic bytes, accepts a candidate if it decodes to a WARC header, and owns every record that starts inside
the range, reading on past the range's end for the last one. So every record is read once, wherever the cuts fall.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy, materialize, new_path, table

MAGIC = b"\x1f\x8b\x08"
#: Equal payloads of this many bytes or more are stored once.
REVISIT_BYTES = 1000
#: Bytes of a range, and of one read.
SPLIT, BUFFER = 64 << 20, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def _member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _uri(url: str) -> str:
    """url with control characters and blanks escaped, which would end a header line."""
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) if b < 128 else f"%{b:02X}" for b in url.encode("utf-8"))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or the revisit record of a page whose payload is that of page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", _uri(url))] if url is not None else []
    headers += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        return _member([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to))], http)
    return _member(headers, http + payload)


def with_originals(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (null: empty), digest and refers_to: the largest page_id with an equal payload, null for that
    page itself, for payloads under `least` bytes and where no equal page has an id. Rows equal in page_id and payload are alike."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("uses")), "digests")
    joined = join_heavy(rows, groups, "digest", "uses")
    original = F.when((F.octet_length("html") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", original.alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, digest, refers_to as .warc.gz files, one per task, in `folder` (any URI that pyarrow
    and all executors reach). Returns the manifest path, bytes, records. Only files of attempts that Spark counts are
    in it: a lost or repeated attempt leaves an unlisted file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = n = 0
        out = None
        for pdf in batches:
            for page_id, url, html, digest, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"], strict=True):
                whole = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                data = page_record(whole[0], url, html.encode("utf-8"), digest, whole[1])
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    # ids as strings: exact for any long, and nulls stay nulls
    ids = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialize(ids.mapInPandas(run, "path string, bytes long, records long"), "manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, block[: int(headers["content-length"])]


def members(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of each record that starts in [start, end) of an open file of `size` bytes.

    Bytes between records that are no member are passed over; a record that breaks off raises ValueError.
    """
    at, data = start, b""  # data holds the file from `at` on

    def more() -> bool:
        nonlocal data
        file.seek(at + len(data))
        got = file.read(min(BUFFER, size - at - len(data))) if at + len(data) < size else b""
        data += got
        return bool(got)

    while at < end:
        hit = data.find(MAGIC)
        if hit < 0:
            keep = min(2, len(data))
            at, data = at + len(data) - keep, data[len(data) - keep :]
            if not more():
                return
            continue
        at, data = at + hit, data[hit:]
        if at >= end:
            return
        z = zlib.decompressobj(31)
        out, fed, good = [], 0, True
        try:
            while not z.eof:
                if fed == len(data) and not more():
                    break
                piece, fed = data[fed:], len(data)
                out.append(z.decompress(piece))
                seen = b"".join(out[:4])[:5]
                if not b"WARC/".startswith(seen) and seen != b"WARC/":
                    good = False
                    break
        except zlib.error:
            good = b"".join(out)[:5] == b"WARC/"
            if good:
                raise ValueError(f"record at byte {at} is damaged") from None
        raw = b"".join(out)
        if good and raw[:5] == b"WARC/":
            if not z.eof:
                raise ValueError(f"record at byte {at} breaks off")
            yield at, raw
            used = len(data) - len(z.unused_data)
        else:
            used = 1
        at, data = at + used, data[used:]


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per record of the files named in path, bytes: path, offset, type, record_id, refers_to, target_uri,
    payload_digest (lower-case hex, from the header), payload_length (of HTTP's Content-Length, else of the payload), payload.

    An empty table of files gives an empty result.
    """
    spans = files.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split}L)")).alias("start"))
    n = spans.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"], strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, raw in members(file, start, min(size, start + split), size):
                        h, block = parse(raw)
                        length = None
                        if h.get("content-type", "").startswith("application/http"):
                            http, _, block = block.partition(b"\r\n\r\n")
                            length = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length"), None)
                        kind, _, digest = h.get("warc-payload-digest", "").partition(":")
                        digest = base64.b32decode(digest).hex() if kind == "sha1" and len(digest) == 32 else digest.lower() or None
                        rows.append((path, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, len(block) if length is None else length, block))
                        held += len(block)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    schema = "path string, offset long, type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length long, payload binary"

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in run(batches):
            yield pdf.set_axis(names, axis=1)

    return spans.repartition(max(1, min(n, 100_000)), "path", "start").mapInPandas(named, schema)


def archive(pages: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Write all pages to archives in folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are taken from its payload as read, those of a revisit from its headers, as the
    payload is stored with the page that it refers to.
    """
    read = read_warc(write_warc(with_originals(pages), folder), split)
    number = "try_cast(regexp_extract({}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)"
    full = F.col("type") == "response"
    return read.select(
        F.expr(number.format("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr(number.format("coalesce(refers_to, '')")).alias("refers_to"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND (page_id IS NULL OR page_id < first) AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= {REVISIT_BYTES} AND (page_id IS NULL OR page_id < first) THEN first END AS refers_to FROM m"""
}
