"""Legacy archive conversion: ARC files (versions 1 and 2) to WARC, with revisit records, and a WARC reader.

An ARC file begins with a version block, whose version decides the fields of each record's header line; the last field declares the
record's length. Conversion reads records by these lengths and synthesises what WARC wants: record ids, ISO timestamps, types and SHA-1
digests. The version block becomes a warcinfo record, content that begins with an HTTP status line a
response, and anything else (dns, ftp, bare content) a resource with its own content type. Responses with equal payloads of at least
``least`` bytes become one response and revisits to it. Everything stays bytes from end to end.

Archives are compressed record by record, one gzip member each, and bounded by ARCHIVE_BYTES; only a record that is larger itself makes a larger file.

Defined cases: a null payload is empty, a null URL is ``-``, bytes that no URI may hold are percent-encoded (and ``#`` in a page's URL), repeated rows are
records of their own (of equal largest ids one is the response), a null id is written as ``null`` and comes last in choosing a response, an empty table
gives no rows, columns that are not named are ignored, a head without a blank line is all of its record, and dates of fewer than 14 digits are
filled up. A file that ends inside a record, lacks its version block, names other fields or holds a header line without an address and a date raises an
error; a later record whose URL begins with ``filedesc:`` is one like others.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from base64 import b32decode, b32encode
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.llm.common import join_cut, scratch_path, small, written

LEAST = 1000
#: Compressed bytes of one archive file, and payload bytes that a reader hands on at once.
ARCHIVE_BYTES, BATCH_BYTES = 32 << 20, 2 << 20
#: Rows (of some 60 bytes) up to which a table of shared payloads or of revisits is broadcast.
BROADCAST_ROWS = 200_000
#: Header fields by ARC version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: What stands for an unknown address and type, and the characters that a URI may hold beside letters and digits.
NO_ADDRESS, NO_TYPE, URI = ("0.0.0.0", "-", ""), ("no-type", "-", ""), "-._~:/?#[]@!$&'()*+,;=%"
#: A header line by ARC version. The URL and the content type may hold spaces; an address and a date part them.
ADDRESS = rb"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-"
HEADER = {
    1: re.compile(rb"(.*) (" + ADDRESS + rb") ([0-9]{4,14}|-) (.*) ([0-9]+)", re.DOTALL),
    2: re.compile(rb"(.*) (" + ADDRESS + rb") ([0-9]{4,14}|-) (.*) ([0-9]{1,3}|-) ([^ ]+) ([^ ]+) ([0-9]+|-) ([^ ]+) ([0-9]+)", re.DOTALL),
}
DATE = "20240102030405"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ID = "#id="
#: A gzip member without content: it ends each file, as Spark's text writer ends each row with something.
NOTHING = gzip.compress(b"", mtime=0)


def arc_url(url: str | None, id: object) -> str:
    """The page's URL with its id as fragment."""
    return f"{quote(url or '-', safe=URI.replace('#', ''))}{ID}{'null' if id is None else id}"


def arc_record(version: int, url: str, content: bytes, offset: int, name: str, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    values = {
        "URL": url, "IP-address": ip, "Archive-date": DATE, "Content-type": kind, "Result-code": "200",
        "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content)),
    }
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def version_block(version: int, name: str) -> bytes:
    content = f"{version} 0 lexshelf\n{' '.join(ARC_FIELDS[version])}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    return " ".join([values.get(f, str(len(content))) for f in ARC_FIELDS[version]]).encode() + b"\n" + content.encode() + b"\n"


def filed(records: Iterator[Callable[[int, str], bytes]], name: str, head: Callable[[str], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """value BINARY: whole archives. Each record is made from its offset and its file's name, and head opens a file."""
    parts, at, n = [], 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

    for record in records:
        file = f"{name}-{n}"
        for make in ([lambda _, f: head(f)] if head and not parts else []) + [record]:
            parts.append(gzip.compress(make(at, file), 1, mtime=0))
            at += len(parts[-1])
        if at >= ARCHIVE_BYTES:
            yield row()
            parts, at, n = [], 0, n + 1
    if parts:
        yield row()


def write_files(archives: DataFrame, path: str) -> None:
    """A file for each row of archives (value BINARY), through Spark's writer and its commits."""
    out = archives.select(F.col("value").cast("string")).write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """ARC files under path: tasks write version 1 and 2 by turns. The payload may be text or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = task % 2 + 1

        def record(i: object, u: str | None, body: bytes) -> Callable[[int, str], bytes]:
            content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
            return lambda at, name: arc_record(version, arc_url(u, i), content, at, name)

        rows = (record(*values) for b in batches for values in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from filed(rows, f"legacy-{task:06d}", lambda name: version_block(version, name))

    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    write_files(pages.select(F.col(id).alias("id"), F.col(url).alias("url"), body.alias("body")).mapInArrow(run, "value binary"), path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of each archive file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("path", "content")


def opened(data: bytes) -> BinaryIO:
    """The archive's records as a stream: compressed ones are inflated as they are read."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse_arc(stream: BinaryIO) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """offset (after inflating), header fields and content of each record; the first one is the version block.

    The version block's first line names the version and its second line the fields; records are cut by declared length. A header line in which an
    address and a date do not stand where its version wants them raises an error.
    """
    at, version = 0, None
    while line := stream.readline():
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        declared = line.rpartition(b" ")[2]
        if not declared.isdigit():
            raise ValueError(f"no length in the header line at byte {start}")
        content = stream.read(int(declared))
        if len(content) < int(declared):
            raise ValueError(f"truncated record at byte {start}")
        at += len(content)
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("no version block")
            said = content.decode("latin-1").split("\n")
            version = int(said[0].split(" ")[0])
            fields = said[1].strip("\r").split(" ") if len(said) > 1 and said[1].strip() else ARC_FIELDS[version]
            if fields != ARC_FIELDS.get(version):
                raise ValueError(f"fields {fields} are not those of version {version}")
        found = HEADER[version].fullmatch(line)
        if not found:
            raise ValueError(f"the header line at byte {start} is not one of version {version}: {line[:200]!r}")
        yield start, dict(zip(ARC_FIELDS[version], found.groups(), strict=True)), content


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, up to and with its blank line, and body."""
    ends = [(at, at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := content.find(mark)) >= 0]
    cut = min(ends)[1] if ends else len(content)
    return content[:cut], content[cut:]


def arc_rows(file: str, data: bytes) -> Iterator[tuple[dict, bytes, bytes]]:
    """ARC_ROWS' columns, head and body of each record of a file.

    The first record is its version block (warcinfo), content that begins with a status line a response, whatever its URL, and anything else a resource.
    """
    for n, (at, h, content) in enumerate(parse_arc(opened(data))):
        kind = "warcinfo" if n == 0 else "response" if content.startswith(b"HTTP/") else "resource"
        head, body = http_parts(content) if kind == "response" else (b"", content)
        url = quote(h["URL"], safe=URI)
        ip, date, own = (h[f].decode("latin-1") for f in ("IP-address", "Archive-date", "Content-type"))
        name = uuid.uuid5(SPACE, f"{file.rpartition('/')[2]}:{at}:{url}")
        row = {"record": str(name), "kind": kind, "url": url, "ip": ip, "date": date, "content_type": own, "size": len(body), "digest": hashlib.sha1(body).hexdigest(), "file": file, "at": at}
        yield row, head, body


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


ARC_ROWS = "record string, kind string, url string, ip string, date string, content_type string, size bigint, digest string, file string, at bigint"


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record (a synthesised UUID), kind, url, ip, date, content_type, size and digest (SHA-1, hex) of the payload, file and the byte in it (after inflating)
    at which the record begins, and, if asked for, head and body."""
    schema = ARC_ROWS + (", head binary, body binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for row, head, body in arc_rows(file, packed.as_py()):
                    rows.append((*row.values(), head, body) if payloads else tuple(row.values()))
                    held += len(head) + len(body) if payloads else 300
                    if held >= BATCH_BYTES:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
                yield batch_of(rows, schema)

    return archive_files(spark, path).mapInArrow(run, schema)


def chosen(records: DataFrame, least: int = LEAST, order: Column | None = None) -> DataFrame:
    """digest, size, n, response, response_url, response_date for payloads that several responses share: counted and reduced, never gathered.

    The one with the largest order, then record id, is the response.
    """
    order = F.lit(0) if order is None else order
    narrow = records.where((F.col("kind") == "response") & (F.col("size") >= least)).select("digest", "size", F.struct(order.alias("order"), "record", "url", "date").alias("r"))
    both = narrow.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).where("n > 1")
    return both.select("digest", "size", "n", F.col("r.record").alias("response"), F.col("r.url").alias("response_url"), F.col("r.date").alias("response_date"))


def stamp(date: str) -> str:
    """An ISO timestamp from up to 14 digits."""
    d = re.sub(r"\D", "", date)[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: dict) -> bytes:
    """One record from a row of read_arc(), with the response that it revisits if it does."""
    kind = "revisit" if r["response"] else r["kind"]
    block = r["head"] if kind == "revisit" else r["head"] + r["body"]
    sha = lambda h: "sha1:" + b32encode(bytes.fromhex(h)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{r['record']}>", f"WARC-Date: {stamp(r['date'])}"]
    head += [f"WARC-Filename: {r['url'].partition('//')[2]}"] if kind == "warcinfo" else [f"WARC-Target-URI: {r['url']}"]
    if r["ip"] not in NO_ADDRESS:
        head.append(f"WARC-IP-Address: {r['ip']}")
    if kind != "warcinfo":
        head += [f"WARC-Payload-Digest: {sha(r['digest'])}", f"WARC-Payload-Length: {r['size']}"]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{r['response']}>",
            f"WARC-Refers-To-Target-URI: {r['response_url']}", f"WARC-Refers-To-Date: {stamp(r['response_date'])}",
        ]
    own = "application/octet-stream" if r["content_type"] in NO_TYPE else r["content_type"]
    if kind in ("response", "revisit"):
        head += [f"WARC-Identified-Payload-Type: {own}", "Content-Type: application/http; msgtype=response"]
    else:
        head.append(f"Content-Type: {own}")
    head += [f"WARC-Block-Digest: {sha(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(records: DataFrame, least: int = LEAST, order: Column | None = None) -> DataFrame:
    """file and verdicts: at, response, response_url and response_date of each of its records that is a revisit. records: read_arc() without payloads, written.

    A file's verdicts are one row, no longer than the file has records.
    """
    shared = written(chosen(records, least, order), "warc-shared")
    keys, responses = ["digest", "size"], records.where((F.col("kind") == "response") & (F.col("size") >= least)).select("digest", "size", "record", "file", "at")
    if (n := shared.count()) <= BROADCAST_ROWS:
        found = responses.join(small(shared.drop("n"), n, BROADCAST_ROWS), keys)
    else:
        found = join_cut(responses, shared.drop("n"), shared, keys, ["record"])
    verdict = F.struct("at", "response", "response_url", "response_date")
    return found.where("record <> response").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.collect_list(verdict).alias("verdicts"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST, order: Column | None = None) -> None:
    """Reads ARC files and writes WARC files: once for the digests alone, once for the payloads.

    Payloads meet no other row. Each file gets the list of its revisits; where these lists are too many to broadcast, the files move to them, packed as they are.
    """
    found = written(revisits(written(read_arc(spark, arc_path, payloads=False), "warc-records"), least, order), "warc-revisits")
    few = int(found.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS
    verdicts = found.select(F.col("file").alias("path"), "verdicts").hint("broadcast" if few else "shuffle_hash")
    files = archive_files(spark, arc_path).join(verdicts, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Callable[[int, str], bytes]]:
            for b in batches:
                for file, packed, said in zip(*b.columns, strict=True):
                    known = {v["at"]: v for v in said.as_py() or []}
                    for row, head, body in arc_rows(file.as_py(), packed.as_py()):
                        row |= {"head": head, "body": body, "response": None, **known.get(row["at"], {})}
                        yield lambda _, __, r=row: warc_record(r)

        yield from filed(records(), "converted")

    write_files(files.select("path", "content", "verdicts").mapInArrow(run, "value binary"), warc_path)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, cut by Content-Length."""
    while line := stream.readline():
        if not re.fullmatch(rb"WARC/[0-9.]+\r\n", line):
            raise ValueError(f"no record where {line[:40]!r} stands")
        fields: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("latin-1").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"truncated record {fields['warc-record-id']}")
        yield fields, block


WARC_ROWS = "uri string, record_type string, content_type string, ip string, payload_bytes bigint, payload_digest string, refers_to_uri string"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """uri, record_type, content_type, ip, payload_bytes, payload_digest and refers_to_uri of each record but warcinfo, from the WARC files alone,
    and, if asked for, the stored payload (null for a revisit). Digests of stored blocks and payloads are checked.
    """
    schema = WARC_ROWS + (", payload binary" if payloads else "")
    plain = lambda digest: b32decode(digest.removeprefix("sha1:")).hex()

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h["warc-type"]
        body = http_parts(block)[1] if kind == "response" else block
        digest = plain(h["warc-payload-digest"])
        if hashlib.sha1(block).hexdigest() != plain(h["warc-block-digest"]) or kind != "revisit" and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"a digest of {h['warc-record-id']} does not match")
        found = (h["warc-target-uri"], kind, h["content-type"], h.get("warc-ip-address"), int(h["warc-payload-length"]), digest, h.get("warc-refers-to-target-uri"))
        return (*found, None if kind == "revisit" else body) if payloads else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(1):
                rows, held = [], 0
                for h, block in parse_warc(opened(packed.as_py())):
                    if h["warc-type"] != "warcinfo":
                        rows.append(row(h, block))
                        held += len(block) if payloads else 200
                    if held >= BATCH_BYTES:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
                yield batch_of(rows, schema)

    return archive_files(spark, path).mapInArrow(run, schema)


def number_of(uri: str) -> Column:
    """The id in a URI's fragment, null for ``null``."""
    return F.expr(f"try_cast(substring_index({uri}, '{ID}', -1) as bigint)")


def archive_pages(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to: pages go to ARC files, those to WARC files, and these are read back."""
    spark = pages.sparkSession
    base = scratch_path(spark, "archives")
    write_arc(pages, f"{base}/arc", id, url, payload)
    convert(spark, f"{base}/arc", f"{base}/warc", least, number_of("url"))
    return read_warc(spark, f"{base}/warc").select(number_of("uri").alias(id), "payload_bytes", "payload_digest", "record_type", number_of("refers_to_uri").alias("refers_to"))
