"""Legacy archive converter: ARC files to WARC records, written and read back.

Archives are parsed by declared lengths. Records are strings of bytes in Spark,
so the text writer puts them into ordinary gzip archives on any file system."""
from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header fields of the two format versions.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length".split(),
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split()}
END = b"\r\n\r\n"
ARC_BYTES = 8 << 20
ARCHIVE_RECORDS = 5_000
RECORD = ("archive string, offset long, page_id long, warc_type string, url string, stamp string, ip string, mime string, "
          "head binary, payload binary, payload_bytes long, payload_digest string")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_file(name: str, version: int, pages: list[tuple[int | None, str | None, bytes]], stamp: str = "20240115060000") -> bytes:
    """One ARC file: the version block, then a record per page."""
    def line(url: str, mime: str, body: bytes, code: int, offset: int) -> bytes:
        middle = f"{code} - - {offset} {name} " if version == 2 else ""
        return f"{url} 0.0.0.0 {stamp} {mime} {middle}{len(body)}\n".encode()
    about = f"{version} 0 raincourier\n{' '.join(FIELDS[version])}\n".encode()
    parts = [line(f"filedesc://{name}", "text/plain", about, 200, 0), about, b"\n"]
    at = sum(map(len, parts))
    for page_id, url, html in pages:
        key = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + key + b"\r\n" + html
        target = quote(url, safe="!#$&'()*+,/:;=?@[]~%-._") if url else "urn:x-no-url"
        new = [line(target, "text/html", body, 200, at), body, b"\n"]
        parts += new
        at += sum(map(len, new))
    return b"".join(parts)


def parse_arc(name: str, content: bytes) -> Iterator[dict]:
    """Records of an ARC file (plain or gzip) of either version, in order. The
    version block says which header fields follow; lengths say where they end.
    A header that does not fit raises ValueError: nothing is skipped."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, fields = 0, None
    while at < len(content):
        stop = content.find(b"\n", at)
        line = content[at:stop if stop >= 0 else len(content)]
        if not line.strip():
            at += len(line) + 1
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r")
        if fields is None:
            size = int(text.rsplit(" ", 1)[1])
            version = int(content[stop + 1:content.find(b"\n", stop + 1)].split()[0])
            fields = FIELDS.get(version)
            if fields is None:
                raise ValueError(f"{name}: unknown ARC version {version}")
        # Some version 1 writers left blanks in the URL: fields are counted from the right.
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"{name}: bad ARC header at byte {at}: {text[:200]}")
        got = dict(zip(fields, values))
        size = int(got["Archive-length"])
        body = content[stop + 1:stop + 1 + size]
        if len(body) < size:
            raise ValueError(f"{name}: record at byte {at} is cut short")
        yield {"offset": at, "url": got["URL"], "ip": got["IP-address"], "stamp": got["Archive-date"], "mime": got["Content-type"], "body": body}
        at = stop + 1 + size + 1


def _described(name: str, rec: dict, whole: bool) -> dict:
    """The fields a WARC record is made of; `whole` keeps the bytes."""
    body, url = rec["body"], rec["url"]
    head, payload, kind, key = b"", body, "resource", None
    if rec["offset"] == 0 and url.startswith("filedesc:"):  # the version block; further on it is a page's url
        kind = "warcinfo"
    elif body.startswith(b"HTTP/"):
        cut = body.find(END)
        head, payload, kind = (body[:cut + 4], body[cut + 4:], "response") if cut >= 0 else (body, b"", "response")
        for field in head.split(b"\r\n")[1:]:
            if field[:10].lower() == b"x-page-id:":
                key = int(field[10:])
    return {"archive": name, "offset": rec["offset"], "page_id": key, "warc_type": kind, "url": url, "stamp": rec["stamp"], "ip": rec["ip"], "mime": rec["mime"],
            "head": head if whole else None, "payload": payload if whole else None, "payload_bytes": len(payload),
            "payload_digest": hashlib.sha256(payload).hexdigest()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_RECORD_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("warc_type", pa.string()), ("url", pa.string()),
                           ("stamp", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def arc_from_pages(pages: DataFrame) -> DataFrame:
    """Pages as legacy archives: rows (name, content), some 8 MB each, both
    versions in turn. A null html is an empty payload."""
    def build(batches):
        held, size, k = [], 0, 0
        for batch in batches:
            for page_id, url, html in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                raw = (html or "").encode()
                held.append((page_id, url, raw))
                size += len(raw)
                if size >= ARC_BYTES:
                    yield whole(held, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield whole(held, k)

    def whole(held, k):
        digest = hashlib.sha256()
        for page_id, url, raw in held:
            digest.update(f"{page_id} {url} {len(raw)}\n".encode("utf-8", "replace"))
        name = f"pages-{TaskContext.get().partitionId()}-{k}-{digest.hexdigest()[:16]}.arc"
        return pa.RecordBatch.from_pydict({"name": [name], "content": pa.array([arc_file(name, 1 + k % 2, held)], pa.binary())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(build, "name string, content binary")


def convert_arc(archives: DataFrame, whole: bool = True) -> DataFrame:
    """Records of ARC files given as rows (name, content): the fields of the
    WARC records to come. Empty archives have none."""
    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for rec in parse_arc(name, content.as_py() or b""):
                    rows.append(_described(name, rec, whole))
                    size += rows[-1]["payload_bytes"] if whole else 200
                    if size >= ARC_BYTES:
                        yield _batch(rows, _RECORD_ARROW)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _RECORD_ARROW)
    return archives.select("name", "content").mapInArrow(parse, RECORD)


def _record_id(archive: Column, offset: Column) -> Column:
    """A name-based UUID of the record's place in the legacy archive: the same on every run."""
    h = F.sha2(F.concat_ws(":", archive, offset.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)), F.lit(">"))


def _iso(stamp: Column) -> Column:
    part = lambda a, n: F.substring(stamp, a, n)
    return F.concat(F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)), F.lit("T"), F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2)), F.lit("Z"))


def resolve_revisits(records: DataFrame, light: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Mark as revisit each response whose payload of at least `least_bytes`
    equals that of a response with a smaller page id (null last, then archive and
    offset), adding the first one's id and place. `light` has the same records without bytes."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset")
    first = (light.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest")
             .agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("payload_digest").alias("d"), "first"))
    joined = records.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("warc_type") == "response"), "left")
    again = F.col("first").isNotNull() & ~((F.col("first.archive") == F.col("archive")) & (F.col("first.offset") == F.col("offset")))
    return joined.withColumns({"warc_type": F.when(again, "revisit").otherwise(F.col("warc_type")), "refers_to": F.when(again, F.col("first.page_id")),
                               "refers_id": F.when(again, _record_id(F.col("first.archive"), F.col("first.offset")))}).drop("d", "first")


def warc_text(records: DataFrame) -> DataFrame:
    """One string of bytes per record, without the blank lines that end it."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    revisit, http = F.col("warc_type") == "revisit", F.col("warc_type").isin("response", "revisit")
    body = F.concat(F.col("head"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    mime = F.when(F.col("warc_type") == "warcinfo", "application/warc-fields").when(F.col("warc_type") == "response", "application/http; msgtype=response").when(
        revisit, "application/http; msgtype=response").otherwise(F.col("mime"))
    head = F.concat(F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", _record_id(F.col("archive"), F.col("offset"))),
                    line("WARC-Date", _iso(F.col("stamp"))), line("WARC-Target-URI", F.when(F.col("warc_type") != "warcinfo", F.col("url"))),
                    line("WARC-IP-Address", F.when(http, F.col("ip"))), line("Content-Type", mime),
                    line("WARC-Payload-Digest", F.when(http, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
                    line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(body))), line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
                    line("WARC-Refers-To", F.col("refers_id")), line("X-Refers-To-Page", F.col("refers_to")), line("X-Payload-Length", F.when(http, F.col("payload_bytes"))),
                    line("X-Page-Id", F.col("page_id")), line("Content-Length", F.length(body)), F.lit("\r\n"))
    return records.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Archives of at most `ARCHIVE_RECORDS` records below `path`; a run that is repeated overwrites them."""
    warc_text(records).write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record of an archive,
    which is unpacked as it is read: one record at a time is in memory."""
    plain = io.BytesIO(content)
    source = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 18) if content[:2] == b"\x1f\x8b" else plain
    k = 0
    while first := source.readline():
        fields, line = {}, b""
        while (line := source.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        if not first.startswith(b"WARC/") or not line or not fields.get("content-length", "").isdigit():
            raise ValueError(f"bad WARC header of record {k}")
        size = int(fields["content-length"])
        block = source.read(size)
        if len(block) < size or source.read(4) != END:
            raise ValueError(f"WARC record {k} has another length than declared")
        yield fields, block
        k += 1


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Page records of the archives below `path`: page_id, record_id, url,
    record_type, payload_bytes, payload_digest, refers_to. Digests of what was
    read are compared with the declared ones; a difference raises ValueError."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: None if x is None else int(x)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse_warc(content.as_py()):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    digest = f["warc-payload-digest"].partition(":")[2]
                    if hashlib.sha1(block).hexdigest() != f["warc-block-digest"].partition(":")[2]:
                        raise ValueError(f"block digest differs: {f['warc-record-id']}")
                    if f["warc-type"] == "response":
                        payload = block.partition(END)[2]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(f["x-payload-length"]):
                            raise ValueError(f"payload digest differs: {f['warc-record-id']}")
                    rows.append({"page_id": number(f.get("x-page-id")), "record_id": f["warc-record-id"], "url": f.get("warc-target-uri"), "record_type": f["warc-type"],
                                 "payload_bytes": int(f["x-payload-length"]), "payload_digest": digest, "refers_to": number(f.get("x-refers-to-page"))})
                if rows:
                    yield _batch(rows, schema)
    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(parse, "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"))


def pages_to_warc(pages: DataFrame, path: str) -> DataFrame:
    """Pages through legacy archives to WARC below `path`, read back: one row
    per page.

    Null html is an empty payload; null ids stay null and never come first among
    equal payloads; null urls get a placeholder; repeated rows are records of
    their own, the first in archive order being the response. Other columns are
    ignored. No pages give no rows."""
    arcs = arc_from_pages(pages)
    write_warc(resolve_revisits(convert_arc(arcs), convert_arc(arcs, whole=False)), path)
    return read_warc(pages.sparkSession, path)
