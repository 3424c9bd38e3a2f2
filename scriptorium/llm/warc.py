"""Legacy archive converter: ARC records to WARC records, written and read back.

`parse_arc` reads version-1 and version-2 archives: the version block that an archive begins with names the version
and so the fields of the header lines, and every record's declared length says where the next one starts. `to_warc`
synthesises the equivalent WARC record: an identifier from the record's own fields and payload, the 14-digit date in
ISO form, the type, and payload and block digests. Bodies are bytes throughout.

Archives hold a gzip member for each record, so that any reader can seek to one. They are written by Spark's text
writer, and so have the commit protocol of any output. It puts a line separator after each value: a member ends with
the upper byte of its length, zero below 16 MiB, which is left off here and put back as the separator (a larger
record is followed by an empty member). Readers decompress one record at a time; small records share files of at most
`records`, and larger ones of so many that FILE bytes hold them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, flat_mapped

#: Fields of the header lines of the two versions.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS, SMALL, FILE = 5_000, 1 << 16, 1 << 28  # records of a file, at most; bytes of a small one; bytes of a file of larger ones


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[tuple[bytes, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An archive of records (url, 14-digit date, content type, body)."""
    fields = " ".join(FIELDS[version])
    head = f"{version} 0 scriptorium\n{fields}\n".encode()
    out = bytearray()

    def record(url: bytes, date: str, kind: str, body: bytes, code: str) -> None:
        known = {"IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": code, "Checksum": sha1(body), "Location": "-", "Offset": str(len(out)), "Filename": name, "Archive-length": str(len(body))}
        out.extend(b" ".join(url if f == "URL" else known[f].encode() for f in FIELDS[version]) + b"\n" + body + b"\n")

    record(f"filedesc://{name}".encode(), "19960101000000", "text/plain", head, "200")
    for url, date, kind, body in records:
        record(url, date, kind, body, "200")
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block; ends at a header that can't be read or a body cut short.

    Bytes of a header that are no UTF-8 are kept as surrogates. Only the first record can be a version block.
    """
    at, fields, first = 0, FIELDS[1], True
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not re.fullmatch("[0-9]+", line[-1]) or len(line) < 5:
            return
        body = data[end + 1 : end + 1 + int(line[-1])]
        if len(body) < int(line[-1]):
            return
        at = end + 1 + len(body)
        block, first = first and line[0].startswith("filedesc:"), False
        if block:
            fields = FIELDS[2] if body[:1] == b"2" else FIELDS[1]
            continue
        # a URL of old archives may hold spaces: the fields are counted from the right
        n = len(fields)
        yield dict(zip(fields, [" ".join(line[: len(line) - n + 1]), *line[len(line) - n + 1 :]], strict=True)), body


def date_of(digits: str) -> str:
    try:
        return datetime.strptime(digits[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1996-01-01T00:00:00Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((url, date, digest, key)).encode('utf-8', 'backslashreplace').decode())}>"


def to_warc(fields: dict[str, str], body: bytes, key: str = "", refers: tuple[str, str] | None = None) -> bytes:
    """The WARC record, with its terminator. body: HTTP header and payload; refers: key and URL of the record with the same payload."""
    cut_at = body.find(b"\r\n\r\n")
    http, payload = (body[: cut_at + 4], body[cut_at + 4 :]) if body.startswith(b"HTTP/") and cut_at >= 0 else (b"", body)
    url, date, digest = fields["URL"], date_of(fields["Archive-date"]), sha1(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response'}", f"WARC-Record-ID: {record_id(url, date, digest, key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", f"X-Source-Key: {key}"]
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers[1], date, digest, refers[0])}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Key: {refers[0]}"]
    head += ["Content-Type: application/http;msgtype=response" if http else f"Content-Type: {fields['Content-type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member without its last byte, which is zero."""
    out = gzip.compress(record, 6, mtime=0)
    return (out if out[-1] == 0 else out + gzip.compress(b"", mtime=0))[:-1]


def members(data: bytes) -> Iterator[bytes]:
    """The contents of each gzip member in turn, without empty ones."""
    at, view = 0, memoryview(data)
    while at < len(data):
        one = zlib.decompressobj(31)
        out = []
        while not one.eof and at < len(data):  # in small parts, as what is left over is handed back
            part = view[at : at + (1 << 16)]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        if record := b"".join(out):
            yield record


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            return
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _one_line(url: str | None) -> str:
    return re.sub(r"[\r\n\x00]", "", url or "") or "about:blank"


def _converted(id_: str | None, url: str | None, body: bytes, refers: str | None, first_url: str | None) -> Iterator[tuple[bytes]]:
    """A page as a record of a legacy archive, version 1 or 2 by its digest, and that as a WARC record."""
    version = 1 + hashlib.sha1(body).digest()[0] % 2
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body)
    made = write_arc([(_one_line(url).encode("utf-8", "surrogatepass"), "19990101000000", "text/html", http + body)], version)
    for fields, both in parse_arc(made):
        yield (member(to_warc(fields, both, id_ or "", None if refers is None else (refers, _one_line(first_url)))),)


def convert(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, records: int = RECORDS) -> None:
    """Pages, as legacy archives of both versions, converted and written as WARC files under path. The payload is text, or bytes of any kind.

    Of records of equal payloads of `least` bytes or more the one of the smallest id is the response and the rest
    are revisits that refer to it. Null payload: an empty one. Null ids: responses. Each row is
    judged by its id, so that of rows that repeat, those of the smallest id are all responses.
    """
    cut = Scratch(pages.sparkSession)
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("body"))
    marked = narrow.withColumn("sum", F.sha1("body")).withColumn("bytes", F.octet_length("body"))
    first = F.min(F.struct("id", "url"))
    shared = cut(marked.where((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("sum").agg(first.alias("f"), F.count("*").alias("c")).where("c > 1").select("sum", "f.id", "f.url").toDF("sum", "first", "first_url"))
    known = marked.join(shared, "sum", "left").withColumn("refers", F.when(F.col("bytes") >= least, F.when(F.col("id") != F.col("first"), F.col("first"))))
    text = known.select(F.col("id").cast("string").alias("id"), "url", "body", F.col("refers").cast("string").alias("refers"), "first_url", "bytes")
    largest = narrow.agg(F.max(F.octet_length("body")).alias("n")).first()["n"] or 0
    for name, some, most in (("small", text.where(F.col("bytes") <= SMALL), records), ("large", text.where(F.col("bytes") > SMALL), max(1, min(records, FILE // max(1, largest))))):
        made = flat_mapped(some, [], ["id", "url", "body", "refers", "first_url"], "value binary", lambda: _converted)
        # bytes as they are: the cast doesn't look at them, nor does the writer
        made.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", most).option("compression", "none").mode("overwrite").text(f"{path}/{name}")
    cut.drop()


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """(key, type, record, refers, refers_to, url, date, digest, sound, payload_bytes, payload) of the WARC records under path.

    A revisit's length is its HTTP header's. sound: whether a response's payload has the digest that its header states.
    payloads: whether they are returned; else null.
    """

    def records(content: bytes) -> Iterator[tuple]:
        for record in members(content):
            for head, block in parse_warc(record):
                http = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", block[:http])[1]) if revisit else len(block) - http
                url = head["WARC-Target-URI"].encode("utf-8", "replace").decode()
                sound = None if revisit else sha1(block[http:]) == digest
                yield head["X-Source-Key"] or None, head["WARC-Type"], head["WARC-Record-ID"], head.get("X-Refers-To-Key"), head.get("WARC-Refers-To"), url, head["WARC-Date"], digest, sound, size, None if revisit or not payloads else block[http:]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    out = "key string, type string, record string, refers string, refers_to string, url string, date string, digest string, sound boolean, payload_bytes long, payload binary"
    return flat_mapped(files, [], ["content"], out, lambda: records)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages converted, written to the shared folder and read back.

    No rows: no rows. Other columns of pages are not read, whatever their names.
    """
    spark = pages.sparkSession
    path = f"{Scratch(spark).top}/warc"
    convert(pages, path, least=least)
    back = read(spark, path, payloads=False)
    return back.where(F.coalesce("sound", F.lit(True))).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast("long").alias("refers_to"))
