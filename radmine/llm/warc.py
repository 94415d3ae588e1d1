"""Legacy ARC archives: writing, reading, conversion to WARC, and reading WARC back.

ARC files open with a filedesc record that names the version; version 1 has five header fields a record, version 2 ten.
Conversion reads header lines by that version and bodies by declared length, and synthesises the WARC record id,
timestamp, type and digests. Records with equal payloads are written once; the others become revisits that refer to it by
its record id. Files are gzip with a member for each record, so that a reader can start at any of them, are bounded in
bytes, and are written and listed by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, join_small, shared_path, stored, table

# Field layouts of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_HEAD = {
    1: re.compile(rb"(.*) (\S+) (\d{8,14}) (.*?) ?(\d+)\Z"),
    2: re.compile(rb"(.*) (\S+) (\d{8,14}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)\Z"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Least payload of a revisit; bytes after which a file is full (a file holds a record more at most).
MIN_REVISIT, FILE_BYTES = 1000, 8 << 20
#: What stands between rows of Spark's text writer: an empty gzip member, which readers of gzip skip.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
#: A WARC header field of ours, and the HTTP header that carries a page's id in ARC records.
PAGE_FIELD, PAGE_HEADER = "X-Page-ID", b"X-Page-Id"


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, name: str = "-", offset: int = 0) -> bytes:
    extra = f"200 {hashlib.sha1(block).hexdigest()} - {offset} {name} " if version == 2 else ""
    return f"{url} {ip} {date} {mime} {extra}{len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the filedesc ones included (version set). The version holds until the next filedesc.

    Before any filedesc, lines are read as version 1. Blank lines between records are skipped. A header that doesn't fit
    its version raises ValueError, as does a body shorter than declared.
    """
    version, at = 1, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        filedesc = line.startswith(b"filedesc:")
        if filedesc and end >= 0:  # the version stands in the body's first line
            version = 2 if data[end + 1 : end + 2] == b"2" else 1
        m = _HEAD[version].match(line)
        if not m or end < 0:
            raise ValueError(f"no ARC version {version} header at byte {at}: {line[:80]!r}")
        f = m.groups()
        size, start = int(f[-1]), end + 1
        block = data[start : start + size]
        if len(block) != size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(block)} are left")
        yield {"version": version, "filedesc": filedesc, "url": f[0], "ip": f[1], "date": f[2], "mime": f[3], "offset": at, "block": block}
        at = start + size


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files (plain or gzip) at path, filedesc records included: file, offset (in the unpacked
    file), version, filedesc, url, ip, date, mime, head (the HTTP header, empty if the record holds no HTTP message),
    payload, digest (SHA-1, lower-case hex), page_id (of the header X-Page-Id, else null). A malformed file is an error that
    names it; an empty folder has no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for path, content in zip(df["path"], df["content"], strict=True):
                data = bytes(content)
                data = gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                try:
                    for r in parse_arc(data):
                        head, body = (b"", r["block"]) if r["filedesc"] else http_parts(r["block"])
                        page = re.search(rb"\r\n" + PAGE_HEADER + rb": (-?\d+)\r\n", head)
                        rows.append((path, r["offset"], r["version"], r["filedesc"], *(r[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "mime")), head, body, hashlib.sha1(body).hexdigest(), int(page[1]) if page else None))
                        size += len(body)
                        if size > 4 << 20:
                            yield _frame(rows, ARC_SCHEMA)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                yield _frame(rows, ARC_SCHEMA)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, ARC_SCHEMA)


ARC_SCHEMA = "file string, offset long, version int, filedesc boolean, url string, ip string, date string, mime string, head binary, payload binary, digest string, page_id long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    df = pd.DataFrame(rows, columns=list(kinds))
    return df.astype({c: "Int64" for c, k in kinds.items() if k == "long"})


def _digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    head, sep, body = block.partition(b"\r\n\r\n")
    return (head + sep, body) if sep and head.startswith(b"HTTP/") else (b"", block)


def warc_record(url: str, ip: str, date: str, mime: str, head: bytes, payload: bytes, digest: str, rid: str, filedesc: bool = False, page: int | None = None, refers_to: str | None = None) -> bytes:
    """One WARC/1.0 record: warcinfo for filedesc, revisit (without payload) if refers_to is given, response for HTTP
    messages, else resource. Dates of fewer than 14 digits are filled up with zeros."""
    date = date.ljust(14, "0")
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    kind = "warcinfo" if filedesc else "revisit" if refers_to else "response" if head else "resource"
    block = head if kind == "revisit" else head + payload
    content = {"warcinfo": "text/plain", "resource": mime or "application/octet-stream"}.get(kind, "application/http; msgtype=response")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {iso}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {_digest(digest)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    if page is not None:
        lines += [f"{PAGE_FIELD}: {page}"]
    if kind == "revisit":
        lines += [f"X-Payload-Length: {len(payload)}"]
    lines += [f"WARC-Block-Digest: {_digest(hashlib.sha1(block).hexdigest())}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        head: dict = {}
        while (line := stream.readline()).strip():
            k, _, v = line.partition(b":")
            head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("truncated WARC record")
        yield head, block


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _files(parts: Iterator[bytes], first: bytes = b"") -> Iterator[pd.DataFrame]:
    """Rows of about FILE_BYTES from members; each row begins with `first`."""
    held, size = [first], len(first)
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= FILE_BYTES:
            yield pd.DataFrame({"value": [b"".join(held)]})
            held, size = [first], len(first)
    if size > len(first):
        yield pd.DataFrame({"value": [b"".join(held)]})


def _save(rows: DataFrame, path: str) -> None:
    """A file for each row; Spark's text writer puts an empty gzip member after it."""
    rows.select(F.col("value").cast("string").alias("value")).write.options(lineSep=EMPTY_MEMBER, encoding="ISO-8859-1", maxRecordsPerFile="1").text(path)


def write_arcs(pages: DataFrame, path: str, version: int = 1, date: str = "20200101000000") -> None:
    """ARC files (gzip) of (page_id, url, html) at path, each html as an HTTP response in UTF-8 whose header carries the
    page's id. Null html: empty payload. Null or empty url: urn:none; white space in one is escaped. Null ids have no
    header; repeated rows are repeated records; an empty table gives no files."""
    frugal(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def members() -> Iterator[bytes]:
            for df in frames:
                for page, url, body in zip(df["page_id"], df["url"], df["payload"], strict=True):
                    own = b"" if pd.isna(page) else PAGE_HEADER + f": {int(page)}\r\n".encode()
                    head = b"HTTP/1.1 200 OK\r\n" + own + f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url if isinstance(url, str) and url else "urn:none")
                    yield _member(arc_record(version, target, "0.0.0.0", date, "text/html", head + body, "pages.arc"))

        yield from _files(members(), _member(arc_filedesc(version, "pages.arc", date)))

    _save(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).mapInPandas(run, "value binary"), path)


def convert_arcs(spark: SparkSession, arcs: str, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """WARC files at path of the ARC files at arcs.

    A record's id is made of its file's name and its offset there, so a task that runs again gives the same ids. Of records
    with equal payloads of at least min_revisit bytes that with the largest page id (then the last by id) is kept whole and
    the others revisit it; records with the largest page id are all kept whole, as are those of a group without ids. Only
    digests and ids are grouped; the payloads aren't shuffled while the table of repeated payloads is small enough to
    broadcast (counted), and salted beyond. Archives without records give no files."""
    frugal(spark)
    rid = F.concat_ws(" ", F.element_at(F.split("file", "/"), -1), F.col("offset").cast("string"))
    records = arc_records(spark, arcs).withColumn("key", rid)
    large = ~F.col("filedesc") & (F.octet_length("payload") >= min_revisit)
    leaders = records.where(large).groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1 and first.page_id is not null")
    leaders = cut(leaders.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.key").alias("first_key")))
    rows = join_small(records, leaders, ["digest"], "left", salt=F.col("offset"))
    again = large & F.col("first_key").isNotNull() & (F.col("key") != F.col("first_key")) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_page")))
    rows = rows.select(*[c for c in records.columns if c != "offset"], F.when(again, F.col("first_key")).alias("refers"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def members() -> Iterator[bytes]:
            for df in frames:
                for r in df.itertuples(index=False):
                    yield _member(warc_record(r.url, r.ip, r.date, r.mime, bytes(r.head), bytes(r.payload), r.digest, record_id(r.key), bool(r.filedesc), None if pd.isna(r.page_id) else int(r.page_id), record_id(r.refers) if isinstance(r.refers, str) else None))

        yield from _files(members())

    _save(rows.mapInPandas(run, "value binary"), path)


WARC_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, warc_date string"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for content in df["content"]:
            rows = []
            for head, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                _, body = http_parts(block)
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind != "revisit" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload digest of {head['warc-record-id']} does not fit")
                page = head.get(PAGE_FIELD.lower())
                size = int(head.get("x-payload-length") or len(body)) if kind == "revisit" else len(body)
                rows.append((None if page is None else int(page), head.get("warc-target-uri"), size, digest, kind, head["warc-record-id"], head.get("warc-refers-to"), head["warc-date"]))
                if len(rows) >= 2000:
                    yield _frame(rows, WARC_SCHEMA)
                    rows = []
            yield _frame(rows, WARC_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record (but warcinfo) of the gzip files at path, with refers_to: the page id of the record that a
    revisit's WARC-Refers-To names, null if that is not at path or has none. Digests of stored payloads are verified."""
    files = spark.read.format("binaryFile").load(path)
    rows = stored(files.select("content").mapInPandas(_read, WARC_SCHEMA), "warc-records")
    named = rows.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    found = cut(rows.select("record_id", "page_id").join(named, "record_id").groupBy("record_id").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("record_id", "refers_to_id"))
    return join_small(rows, found, ["refers_to_id"], "left", salt=F.col("record_id")).select(*rows.columns, "refers_to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC, and read back."""
    pages, arcs, path = table(spark, sf_dir, "pages"), shared_path(spark, "arcs"), shared_path(spark, "warcs")
    newer = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == 1
    write_arcs(pages.where(~newer), f"{arcs}/v1", 1)
    write_arcs(pages.where(newer), f"{arcs}/v2", 2)
    convert_arcs(spark, f"{arcs}/*", path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""
