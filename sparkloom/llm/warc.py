"""WARC: a converter of legacy ARC archives.

An ARC file begins with a version block, whose body's first line names the version and whose second the fields of the records'
header lines: version 1 has URL, IP address, date, type and length; version 2 also result code, checksum, location, offset and
file name. A record is its header line, so many bytes as declared, and a newline. The converter parses these and synthesises a
WARC record's identifier (a name-based UUID of page and digest), its date (14 digits to ISO 8601), its type, and its payload
and block digests (SHA-1 in base 32).

`read_arc_files` reads archives of storage, plain or gzipped (a member for each record, or one for all): a row a record.
`convert_arc_files` writes them as WARC files. Bytes are unzipped and parsed as they come, so a task holds the file as it is stored,
one record and the output of FILE_BYTES. URLs may hold raw spaces: the address and the date behind them tell where they end. Dates
with missing or impossible parts become the first moment that the others allow. A record of an HTTP answer is a response of that
type; any other, such as a `dns:` one, is a resource of the type that its header line declares.

A further version block, as of archives that were joined, sets the fields from there on. A newline that is missing between
records is no fault. A record is damaged if what follows its declared bytes is neither the end nor a header line: its block then
goes up to the next header line, or to the end where there is none. Lines that are no header, and what can't be unzipped, are a
record of their own without a URL. `problem` says what is wrong, so that no byte is lost without a word.

Plan. Payload digests are computed by Spark; per digest the smallest page_id is found by a partial aggregation. Only digests
of two or more pages are joined back: broadcast up to BROADCAST_ROWS of them, else by shuffle on the digest and a salt, so
that a payload that a third of all pages share is dealt over SALTS tasks. Each task then writes its pages as ARC files in
memory, alternately of either version, and converts them. Each becomes a WARC file, beginning with a warcinfo record, of at most
FILE_BYTES or of one page. They are written by Spark's text writer (a record ends in a newline, so a file is exactly its records)
to the shared folder, and read back as whole files and parsed by declared lengths.

Defined results: null html is the empty payload. A null page_id never is the smallest; a payload of such pages only has
responses only. Rows that repeat the smallest page_id are responses too. A null url is written as `unknown:`. An empty table
gives an empty result. A very long page is a file of its own. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import save

BROADCAST_ROWS = 500_000
SALTS = 64
FILE_BYTES = 32_000_000
LEAST_BYTES = 0  # of a payload, for a revisit

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URL_SAFE = "%/:=&?~#+!$,;'@()*[]"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    status: int | None = None
    problem: str | None = None
    version: bytes | None = None  # of the version block before it, where it is the first record after that


def http_block(payload: bytes, mime: str) -> bytes:
    return f"HTTP/1.0 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An archive of version 1 or 2."""
    body = f"{version} 0 sparkloom\n{ARC_FIELDS[version]}\n".encode()
    parts, place = [], 0

    def add(url: str, ip: str, when: str, mime: str, block: bytes, status: int) -> None:
        nonlocal place
        more = f" {status} {sha1_32(block)} - {place} {name}" if version == 2 else ""
        part = f"{url} {ip} {when} {mime}{more} {len(block)}\n".encode() + block + b"\n"
        parts.append(part)
        place += len(part)

    add(f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, 200)
    for r in records:
        add(quote(r.url, safe=URL_SAFE) or "unknown:", r.ip, r.date, r.mime, r.block, r.status or 200)
    return b"".join(parts)


#: A header line: URL, address, date, what depends on the fields, and the length. The first form allows spaces in the URL.
LINE = 1 << 16  # bytes of a header line at most
ADDRESS = rb"(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+)"
HEADERS = [re.compile(rb"(%s) (%s) ([0-9]{4,17}) ([^\r\n]*?)(-?[0-9]+)\r?(?:\n|$)" % x) for x in ((rb"[^ \r\n][^\r\n]{0,32000}?", ADDRESS), (rb"[^ \r\n]+", rb"[^ \r\n]+"))]
CHUNK = 1 << 16  # compressed bytes that are unzipped at once


def header(data: bytes | bytearray, at: int) -> re.Match | None:
    return HEADERS[0].match(data, at) or HEADERS[1].match(data, at)


def members(data: bytes) -> Iterator[Iterator[bytes]]:
    """The members of a gzipped archive, each in parts; other bytes as they are. Raises zlib.error or EOFError at what can't be unzipped."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield iter([data])
        return

    def parts() -> Iterator[bytes]:
        nonlocal at
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise EOFError("the last member is cut")
            given = view[at : at + CHUNK]
            out = member.decompress(given, CHUNK * 16)
            while member.unconsumed_tail:
                yield out
                out = member.decompress(member.unconsumed_tail, CHUNK * 16)
            at += len(given) - len(member.unused_data)
            yield out

    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b":
            if not any(view[at : at + CHUNK]):  # padding
                at += CHUNK
                continue
            raise zlib.error(f"no member at {at}")
        yield parts()


class Incoming:
    """Bytes that come in parts: `held` from `at` on is what isn't read yet."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.held, self.at, self.problem = parts, bytearray(), 0, None

    def has(self, n: int) -> bool:
        """Whether there are n bytes, which are then held."""
        while self.problem is None and len(self.held) - self.at < n:
            try:
                part = next(self.parts, None)
            except (zlib.error, EOFError) as e:
                part, self.problem = None, f"the rest can't be unzipped: {e}"
            if part is None:
                self.problem = self.problem or ""
                break
            self.held += part
        return len(self.held) - self.at >= n

    def drop(self) -> None:
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0

    def next_header(self, start: int) -> int:
        """Where the next line behind so many bytes begins that is a header; the end without one."""
        place = self.at + start
        while True:
            cut = self.held.find(b"\n", place)
            if cut < 0:
                place = len(self.held)
                if not self.has(len(self.held) - self.at + 1):
                    return len(self.held)
                continue
            place = cut + 1
            self.has(place - self.at + LINE)
            if header(self.held, place):
                return place


def read_arc(data: bytes, strict: bool = True) -> Iterator[ArcRecord]:
    """The records of an archive of either version, plain or gzipped; see above for damaged ones, which strict raises."""
    fields, version = ARC_FIELDS[1].split(" "), None
    each = members(data)
    while True:
        try:
            parts = next(each, None)
        except zlib.error as e:
            if strict:
                raise ValueError(str(e)) from e
            yield ArcRecord("", "", "", "", b"", None, f"the rest can't be unzipped: {e}", version)
            return
        if parts is None:
            return
        source = Incoming(parts)
        while source.has(1):
            source.drop()
            if source.held[source.at] in b"\r\n":
                source.at += 1
                continue
            source.has(LINE)
            line = header(source.held, source.at)
            if line is None:
                if strict:
                    raise ValueError(f"no header line in {bytes(source.held[source.at : source.at + 60])!r}")
                end = source.next_header(0)
                lost, source.at = bytes(source.held[source.at : end]), end
                yield ArcRecord("", "", "", "", lost, None, "no header line", version)
                version = None
                continue
            url, ip, date, rest = (line.group(i).decode("utf-8", "replace") for i in (1, 2, 3, 4))
            length, problem = int(line.group(5)), None
            begin = line.end() - source.at
            whole = length >= 0 and source.has(begin + length)
            source.has(begin + max(length, 0) + LINE)
            after = source.at + begin + length
            if not whole or not (after == len(source.held) or source.held[after] in b"\r\n" or header(source.held, after)):
                problem = f"{length} bytes declared"
                if strict:
                    raise ValueError(f"the record of {url} is damaged: {problem}")
                after = source.next_header(begin)
            block, source.at = bytes(source.held[source.at + begin : after]), after
            if problem:
                block = block.removesuffix(b"\n")
            if url.startswith("filedesc:"):
                lines = block.decode("utf-8", "replace").splitlines()
                kind = lines[0].split(" ")[0] if lines else ""
                fields = lines[1].split(" ") if len(lines) > 1 else ARC_FIELDS[2 if kind == "2" else 1].split(" ")
                version = block
                continue
            mime, *more = rest.rstrip(" ").rsplit(" ", max(0, len(fields) - 5))  # a type may have spaces in it
            said = dict(zip(fields[4:], more))
            code = said.get("Result-code", "-")
            yield ArcRecord(url, ip, date, mime, block, int(code) if code.isdigit() else None, problem, version)
            version = None
        if source.problem:
            if strict:
                raise ValueError(source.problem)
            yield ArcRecord("", "", "", "", b"", None, source.problem, version)
            return


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, url, ip, date, mime, status, payload, problem) of the records of ARC files of either version, plain or gzipped; payload:
    what follows an HTTP header. A file is read by one task."""
    schema = "file string, url string, ip string, date string, mime string, status int, payload binary, problem string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.string()]
        for batch in rows:
            for name, content in zip(batch.column(0), batch.column(1)):
                held: list[tuple] = []
                size = 0
                for r in read_arc(content.as_py(), strict=False):
                    held.append((name.as_py(), r.url, r.ip, iso_date(r.date) if r.date else None, r.mime, r.status, payload_of(r.block), r.problem))
                    size += len(r.block)
                    if size > FILE_BYTES:
                        yield table_of(held, kinds, schema)
                        held, size = [], 0
                if held:
                    yield table_of(held, kinds, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def table_of(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in schema.split(", ")])


def iso_date(digits: str) -> str:
    """Year to second of up to 14 digits; from the first part on that is missing or impossible, the least there are."""
    parts, least = [1, 1, 1, 0, 0, 0], (0, 4, 6, 8, 10, 12, 14)
    for i in range(6):
        piece = digits[least[i] : least[i + 1]]
        try:
            now = [*parts[:i], int(piece), *parts[i + 1 :]]
            datetime(*now)
        except ValueError:
            break
        parts = now
    return datetime(*parts).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def record_id(page: int | str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}/{digest}')}>"


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    cut = block.find(b"\r\n\r\n")
    return block[cut + 4 :] if block.startswith(b"HTTP/") and cut >= 0 else block


def to_warc(record: ArcRecord, page: int | str | None, refers_to: int | None, info: str) -> bytes:
    """The WARC record of an ARC record; a revisit of a page if refers_to is given. page: what tells it from others, the number of a page
    or any name. info: the identifier of the file's warcinfo."""
    payload = payload_of(record.block)
    digest = sha1_32(payload)
    http = record.block.startswith(b"HTTP/")
    lines = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response' if http else 'resource'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Warcinfo-ID: {info}",
        f"WARC-Target-URI: {quote(record.url, safe=URL_SAFE) or 'unknown:'}",
        f"WARC-IP-Address: {record.ip or '0.0.0.0'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: {'application/http; msgtype=response' if http else record.mime or 'application/octet-stream'}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if not isinstance(page, str):
        lines.append(f"X-Page-Id: {'' if page is None else page}")
    if record.problem:
        lines.append(f"X-Problem: {record.problem}")
    block = record.block
    if refers_to is not None:
        block = block[: len(block) - len(payload)]
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return whole_record(lines, block)


def whole_record(lines: list[str], block: bytes) -> bytes:
    head = ["WARC/1.0", *lines, f"WARC-Block-Digest: sha1:{sha1_32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, about: bytes, date: str) -> tuple[str, bytes]:
    """The identifier and the record that a WARC file begins with."""
    info = f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"
    text = b"software: sparkloom\r\nformat: WARC File Format 1.0\r\ndescription: converted from an ARC file\r\n" + about
    return info, whole_record(["WARC-Type: warcinfo", f"WARC-Record-ID: {info}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], text)


def warc_file(legacy: bytes, pages: list[int | None], refers: list[int | None]) -> bytes:
    """The WARC file of an ARC file, whose records are of these pages."""
    info, first = warcinfo(f"{hashlib.sha1(legacy).hexdigest()}/{pages[0]}", b"", "2024-01-01T00:00:00Z")
    return first + b"".join(to_warc(r, i, to, info) for i, to, r in zip(pages, refers, read_arc(legacy), strict=True))


def warc_files(name: str, content: bytes, most: int = FILE_BYTES) -> Iterator[bytes]:
    """An ARC file of this name as WARC files of at most so many bytes, or of one record, each beginning with a warcinfo that has the ARC
    file's name and version block. Records are told apart by the file's name and their number in it."""
    about, out, size = f"arc-file: {name}\r\n".encode(), [], 0
    info, first = "", b""
    for number, r in enumerate(read_arc(content, strict=False)):
        if r.version is not None:
            said = b" / ".join(r.version.split(b"\n")).strip(b" /\r")
            about = f"arc-file: {name}\r\narc-version-block: ".encode() + said.replace(b"\r", b"") + b"\r\n"
        if not out:
            info, first = warcinfo(f"{name}/{number}", about, iso_date(r.date))
            out, size = [first], len(first)
        record = to_warc(r, f"{name}#{number}", None, info)
        if len(out) > 1 and size + len(record) > most:
            yield b"".join(out)
            info, first = warcinfo(f"{name}/{number}", about, iso_date(r.date))
            record = to_warc(r, f"{name}#{number}", None, info)
            out, size = [first], len(first)
        out.append(record)
        size += len(record)
    if out:
        yield b"".join(out)


def convert_arc_files(spark: SparkSession, path: str, into: str | None = None) -> str:
    """WARC files of all ARC files of a path, written to a folder (a new one of the shared folder unless given), whose path is returned.
    An ARC file is one task's; what it becomes is written as it is made."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, content in zip(batch.column(0), batch.column(1)):
                for out in warc_files(name.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([out[:-1]], pa.binary())], ["file"])  # the writer ends it with a newline

    into = into or scratch(spark, "warc")
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(into)
    return into


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; names in lower case."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        yield headers, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4


def page_row(headers: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), digests verified; None for records of other types."""
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    if sha1_32(block) != headers["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {headers['warc-record-id']}")
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    if kind == "response":
        payload = payload_of(block)
        if (sha1_32(payload), len(payload)) != (digest, size):
            raise ValueError(f"payload digest of {headers['warc-record-id']}")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id")


def originals(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of an equal payload, where it is another one."""
    html: Column = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(html)).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    long = F.octet_length(html) >= least
    parts = rows.filter(long).groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    whole = parts.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    several = save(whole.filter("n > 1 AND least IS NOT NULL"), "warc-originals")
    if several.count() <= BROADCAST_ROWS:
        side = F.broadcast(several.select(F.col("digest").alias("d"), "least"))
        joined = rows.join(side, F.col("digest") == F.col("d"), "left")
    else:
        side = several.select(F.col("digest").alias("d"), "least", F.explode("salts").alias("s"))
        joined = rows.join(side, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    other = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")) & long
    return joined.select("page_id", "url", "html", F.when(other, F.col("least")).alias("refers_to"))


def convert(pages: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """One column, file: WARC files of pages (page_id, url, html, refers_to) by way of ARC files, less their last newline."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, size = 1, 0
        ids, refers, records = [], [], []

        def made() -> pa.RecordBatch:
            out = warc_file(write_arc(records, version), ids, refers)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["file"])

        for batch in rows:
            for page, url, html, to in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)):
                block = http_block(html.as_py() or b"", "text/html")
                if records and size + len(block) > most:
                    yield made()
                    version, size = 3 - version, 0
                    ids, refers, records = [], [], []
                ids.append(page.as_py())
                refers.append(to.as_py())
                records.append(ArcRecord(url.as_py() or "unknown:", "0.0.0.0", "20240101000000", "text/html", block))
                size += len(block)
        if records:
            yield made()

    return pages.mapInArrow(run, "file binary")


def write_archives(pages: DataFrame) -> str:
    """WARC files of pages (page_id, url, html, refers_to) in a new folder of the shared one; its path."""
    path = scratch(pages.sparkSession, "warc")
    convert(pages, FILE_BYTES).select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of WARC files."""

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in rows:
            for content in batch.column(0):
                found = [r for h, b in read_warc(content.as_py()) if (r := page_row(h, b))]
                if found:
                    yield table_of(found, kinds, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page converted to a WARC record, and the archives read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(spark, write_archives(originals(pages)))
