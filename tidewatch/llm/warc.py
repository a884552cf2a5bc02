"""Legacy archives: ARC files to WARC files and back to records.

An ARC file opens with a version block whose URL-record definition fixes the header fields of all records that follow:
version 1 has five fields, version 2 ten.  A record is a header line, ``Archive-length`` bytes and a line feed.  The
converter takes the declared lengths, never line breaks, for the ends of records, and makes WARC/1.1 records from them:
identifiers from a digest of content and place, ISO timestamps from 14-digit dates (shorter ones are filled up), types from
the content (warcinfo for a file's version block, response for HTTP messages, resource otherwise) and SHA-1 block and payload digests.  Of records with
equal payloads of ``least`` bytes or more the one with the smallest key is the response; the others become revisits.

Files are written and read by Spark, so any store that Spark reaches will do: the text writer puts out one value per record,
the record's own terminator is its line separator, and strings carry arbitrary bytes.  Each file holds about ``FILE_BYTES``
before compression and is parsed as a stream inside one task.

Defined cases: null or empty payloads are records of zero bytes; null and empty URLs are written as ``-``; a null key sorts after all others and reads back as
null; repeated rows are records of their own (equal keys: the first by address is the response); an empty table makes no
files and reads back as no rows; extra columns are ignored.  A file that ends inside a record raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20
#: The URL-record definitions of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = "X-Archive-Key"
_ARC = "file string, at bigint, url string, date string, block_bytes bigint, payload_bytes bigint, payload_sha1 string, key string, http boolean"
_WARC = "type string, id string, uri string, date string, refers_to string, payload_digest string, length bigint, key string, payload_bytes bigint, found_digest string"
_VALUES = "file string, seq bigint, value binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def http_head(block: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the HTTP head with its blank line, and its fields by lower-case name; 0 where the block is no HTTP message."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, {}
    lines = _text(block[:end]).split("\r\n")[1:]
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Stream:
    """Bytes of a file, plain or in gzip members, taken by line or by count; holds one record and one piece at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 16):
        self.data, self.at, self.piece = memoryview(data), 0, piece
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.held, self.pos = b"", 0

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = bytes(self.data[self.at : self.at + self.piece])
        self.at += len(part)
        if self.zip:
            out = self.zip.decompress(part)
            if self.zip.eof:  # the next member begins in what is left
                self.at -= len(self.zip.unused_data)
                self.zip = zlib.decompressobj(31)
            part = out
        self.held, self.pos = self.held[self.pos :] + part, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the file."""
        while (end := self.held.find(b"\n", self.pos)) < 0:
            if not self._more():
                rest, self.held, self.pos = self.held[self.pos :], b"", 0
                return rest or None
        found, self.pos = self.held[self.pos : end], end + 1
        return found.rstrip(b"\r")

    def take(self, count: int) -> bytes:
        parts, need = [], count
        while need:
            part = self.held[self.pos : self.pos + need]
            parts.append(part)
            self.pos += len(part)
            need -= len(part)
            if need and not self._more():
                raise ValueError(f"a record declares {count} bytes, {need} are missing")
        return b"".join(parts)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an ARC file but its version block."""
    stream, names = Stream(data), None
    while (line := stream.line()) is not None:
        if not line:
            continue
        if names is None:
            block = stream.take(int(line.rsplit(b" ", 1)[1]))
            version, definition = block.split(b"\n", 2)[:2]
            names = _text(definition).split()
            if version.split()[:1] not in ([b"1"], [b"2"]) or names[-1:] != ["Archive-length"]:
                raise ValueError(f"unknown ARC version block: {block[:80]!r}")
            continue
        # The URL is the only field that may hold blanks, so the others are split off from the right.
        values = _text(line).rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} of {len(names)} fields")
        fields = dict(zip(names, values, strict=True))
        yield fields, stream.take(int(fields["Archive-length"]))


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a WARC file."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        fields = {}
        while line := stream.line():
            k, _, v = _text(line).partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.take(int(fields["content-length"]))


def _batched(records, schema: pa.Schema, weigh, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes."""
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += weigh(r)
        if held >= most:
            yield _table(rows, schema).to_batches()[0]
            rows, held = [], 0
    if rows:
        yield _table(rows, schema).to_batches()[0]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_VALUE_TYPES = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])


def _write(values: DataFrame, path: str, separator: str) -> None:
    """(file, seq, value) to one gzip file per ``file``, in order; the rows of a file are in one partition already."""
    ordered = values.sortWithinPartitions("file", "seq").select("file", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("file").option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> None:
    """Pages as HTTP messages in ARC files, version 1 and 2 in turn.  Every task writes files of its own, so no page moves."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    address = F.coalesce(F.nullif(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20]+", "%20"), F.lit("")), F.lit("-"))

    def run(batches):
        part = TaskContext.get().partitionId()

        def records():
            name, number, held, seq = "", 0, file_bytes, 0
            for batch in batches:
                for u, k, t in zip(batch.column("url"), batch.column("key"), batch.column("body"), strict=True):
                    if held >= file_bytes:
                        version, name, number, held, seq = 1 + (part + number) % 2, f"{part:06d}-{number:04d}", number + 1, 0, 0
                        block = f"{version} 0 tidewatch\n{ARC_FIELDS[version]}\n".encode()
                        yield name, seq, f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block
                    data = t.as_buffer().to_pybytes()
                    named = f"{KEY_HEADER}: {k.as_py()}\r\n" if k.is_valid else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n{named}\r\n".encode()
                    size = len(head) + len(data)
                    tail = f"text/html {size}" if version == 1 else f"text/html 200 - - 0 {name} {size}"
                    held, seq = held + size, seq + 1
                    yield name, seq, f"{u.as_py()} 0.0.0.0 {date} {tail}\n".encode() + head + data

        yield from _batched(records(), _VALUE_TYPES, lambda r: 100 + len(r[2]))

    rows = pages.select(address.alias("url"), F.col(key).cast("string").alias("key"), body.alias("body"))
    _write(rows.mapInArrow(run, _VALUES), path, "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile")
    found = found.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("file"), "content")


_ARC_TYPES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_sha1", pa.string()), ("key", pa.string()), ("http", pa.bool_())])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files below ``path`` without their bytes, which stay in the task that parses a file."""
    def parse(batches):
        def records():
            for batch in batches:
                for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                    for at, (f, block) in enumerate(arc_records(content.as_buffer().to_pybytes())):
                        head, http = http_head(block)
                        yield name.as_py(), at, f["URL"], f["Archive-date"], len(block), len(block) - head, base32_sha1(block[head:]), http.get(KEY_HEADER.lower()), head > 0

        yield from _batched(records(), _ARC_TYPES, lambda r: 300)

    return _files(spark, path).mapInArrow(parse, _ARC)


def iso_date(date: str) -> str:
    """14 digits, or fewer from the left, as an ISO timestamp."""
    full = (date + "19700101000000"[len(date):])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(chr(1).join(parts).encode()).hexdigest())}>"


def warc_record(kind: str, name: str, uri: str, date: str, content: str, block: bytes, fields: dict[str, str]) -> bytes:
    """A record without the two empty lines that end it."""
    listed = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": uri, "WARC-Date": date, **fields, "Content-Type": content, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in listed.items() if v) + "\r\n").encode() + block


def _converted(file: str, data: bytes, again: dict[int, dict]) -> Iterator[tuple[str, int, bytes]]:
    """(file, seq, value) of the WARC records of one ARC file; ``again`` has what each repeated record refers to."""
    info = f"software: tidewatch\r\nformat: WARC File Format 1.1\r\nisPartOf: {file}\r\n".encode()
    yield file, -1, warc_record("warcinfo", record_id(file), "", iso_date("1970"), "application/warc-fields", info, {})
    for at, (f, block) in enumerate(arc_records(data)):
        head, _ = http_head(block)
        digest = base32_sha1(block[head:])
        fields = {"WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": f"sha1:{digest}"}
        kind, kept, to = "response" if head else "resource", block, again.get(at)
        if to:
            kind, kept = "revisit", block[:head]
            fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(to["to_file"], str(to["to_at"]), digest),
                       "WARC-Refers-To-Target-URI": to["to_url"], "WARC-Refers-To-Date": iso_date(to["to_date"]), "X-Refers-To-Key": to["to_key"] or "-"}
        else:
            fields["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
        content = "application/http; msgtype=response" if head else f["Content-type"]
        yield file, at, warc_record(kind, record_id(file, str(at), digest), f["URL"], iso_date(f["Archive-date"]), content, kept, fields)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """ARC files to WARC files, one for one.

    The first of equal payloads is found on short rows (digest, key, place) in a pass that keeps the bytes in the tasks.  Then each file,
    still compressed, meets the list of its repeated records and is rewritten by one task, so no payload moves on its own and no
    digest draws its records into one task.
    """
    place = F.struct(F.col("key").isNull().alias("n"), F.col("key").try_cast("bigint").alias("num"), F.col("key").alias("key"), "file", "at", "url", "date")
    short = read_arc(spark, arc_path).where(F.col("payload_bytes") >= least)
    firsts = short.groupBy("payload_sha1", "payload_bytes").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = short.join(firsts, ["payload_sha1", "payload_bytes"]).where((F.col("file") != F.col("f.file")) | (F.col("at") != F.col("f.at")))
    again = again.select("file", "at", F.col("f.key").alias("to_key"), F.col("f.file").alias("to_file"), F.col("f.at").alias("to_at"), F.col("f.url").alias("to_url"), F.col("f.date").alias("to_date"))

    def rewrite(archive: pa.Table, repeats: pa.Table) -> pa.Table:
        found = {r["at"]: r for r in repeats.to_pylist()}
        rows = [x for name, content in zip(archive["file"], archive["content"], strict=True) for x in _converted(name.as_py(), content.as_buffer().to_pybytes(), found)]
        return _table(rows, _VALUE_TYPES)

    values = _files(spark, arc_path).groupBy("file").cogroup(again.groupBy("file")).applyInArrow(rewrite, _VALUES)
    _write(values, warc_path, "\r\n\r\n")


_WARC_TYPES = pa.schema([("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                         ("length", pa.int64()), ("key", pa.string()), ("payload_bytes", pa.int64()), ("found_digest", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path`` but for the files' own descriptions: type, id, uri, date, refers_to (the key of the first), the declared payload digest, and key, bytes and digest of
    the payload as found; a revisit holds no payload, so bytes come from its HTTP head and the found digest is null."""
    def parse(batches):
        def records():
            for batch in batches:
                for content in batch.column("content"):
                    for f, block in warc_records(content.as_buffer().to_pybytes()):
                        if f["warc-type"] == "warcinfo":
                            continue
                        head, http = http_head(block)
                        again = f["warc-type"] == "revisit"
                        length = int(http["content-length"]) if again else len(block) - head
                        to = f.get("x-refers-to-key")
                        yield (f["warc-type"], f["warc-record-id"], f["warc-target-uri"], f["warc-date"], None if to == "-" else to, f["warc-payload-digest"].removeprefix("sha1:"),
                               len(block), http.get(KEY_HEADER.lower()), length, None if again else base32_sha1(block[head:]))

        yield from _batched(records(), _WARC_TYPES, lambda r: 500)

    return _files(spark, path).mapInArrow(parse, _WARC)
