"""Media columns: MPEG audio. A parser for whole streams, and a lossless container for bytes made of valid frames.

The parser reads tags (ID3v2.2 to 2.4 in front, ID3v1 behind), resynchronises on frame headers (a header counts if the frame
that it declares ends at another header of the same kind, at a tag, or at the end), reads variable-bitrate tables (Xing, Info,
VBRI) with an encoder's delay and padding, verifies the 16-bit checksums of all three layers, and gives the exact duration
(samples less delay and padding, over the rate) and each frame's offset. Frames of a free format take the length that leads from
one header to the next. `TAG` 128 bytes before the end is a tag unless a frame in step goes over that place to the end or to
another header.

The container is MPEG-1 Layer III at 32 kHz: silent frames with zero side information, protected by checksums, whose ancillary
bytes carry the payload; a Xing table in front has the frame count, the byte count and the seek table; an ID3v2 tag has the
payload's length. The payload is the text's UTF-8 with zeros up to a positive multiple of 64 bytes. The parser stays in step from
the table to the last frame, so nothing that a payload holds is taken for a header or a tag.

Defined results: null and empty texts are 64 zero bytes. Equal texts give equal values. Ids (null too) are passed through, repeated
rows are stored one by one, other columns of the documents are not looked at, and an empty table gives an empty result. A very
long text is a stream of as many frames as it needs, one row in memory. Rows are independent: no shuffle and no key; batches are
cut by size. `probe` takes streams from anywhere: the payload columns are null for one that store() didn't make, all columns but
media_bytes and media_sha256 for bytes without a frame, and all columns for null. A column of the caller's that has the name of an
added one stays; the added one then has an underscore behind its name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import unused
from .jaccard_join import byte_batches

# Fixed values of the format. Versions: 0 MPEG-2.5, 2 MPEG-2, 3 MPEG-1. Layers: 1 III, 2 II, 3 I. Kilobits a second by index.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
KBPS = {
    (1, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 3): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Layer II: bits of an allocation by subband, as (subbands, bits), of tables a to d of MPEG-1 and that of MPEG-2.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
SEEK_POINTS = 100
ENCODERS = (b"LAME", b"Lavf", b"Lavc", b"GOGO")  # after whose names delay and padding follow
LONGEST_FREE = 8192  # bytes of a free-format frame


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    extension: int
    length: int
    samples: int

    @property
    def kind(self) -> tuple[int, int, int, bool]:
        return self.version, self.layer, self.rate, self.free

    @property
    def free(self) -> bool:
        """Of a free format: the length is that of the padding alone."""
        return not self.kbps

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def bound(self) -> int:
        """The first subband that both channels share."""
        return (self.extension + 1) * 4 if self.mode == 1 else 32

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def read_header(raw: bytes) -> Header | None:
    """Of four bytes; None if they are no header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate = raw[1] >> 3 & 3, raw[1] >> 1 & 3, raw[2] >> 2 & 3
    index = raw[2] >> 4
    if version == 1 or layer == 0 or rate == 3 or index == 15 or raw[3] & 3 == 2:
        return None
    kbps = KBPS[1 if version == 3 else 2, layer][index]
    hertz, padding = RATES[version][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 3 else 576 if layer == 1 and version != 3 else 1152
    length = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 3 else samples // 8 * kbps * 1000 // hertz + padding
    return Header(version, layer, not raw[1] & 1, kbps, hertz, padding, raw[3] >> 6, raw[3] >> 4 & 3, length, samples)


def crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (CRC_POLYNOMIAL if value & 0x8000 else 0)) & 0xFFFF
        table.append(value)
    return table


CRC = crc_table()


@lru_cache(4096)
def crc16(data: bytes, spare: int = 0) -> int:
    """Of all bits but so many last ones (under eight)."""
    value = CRC_START
    for byte in data[:-1] if spare else data:
        value = (value << 8 & 0xFFFF) ^ CRC[value >> 8 ^ byte]
    for k in range(8 - spare if spare else 0):
        value = (value << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if value >> 15 ^ data[-1] >> 7 - k & 1 else 0)
    return value


def guarded_bits(body: bytes, header: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocations (and, in Layer II, what selects scale factors)."""
    if header.layer == 1:
        return header.side * 8
    channels = 1 if header.mono else 2
    if header.layer == 3:
        return 4 * (channels * header.bound + 32 - header.bound) if not header.mono else 128
    own = header.kbps // channels
    if header.version != 3:
        name = "low"
    elif header.free or own > 80:
        name = "a" if header.rate == 48000 else "b"
    else:
        name = "a" if own > 48 else "d" if header.rate == 32000 else "c"
    value, size = int.from_bytes(body[:64], "big"), len(body[:64]) * 8
    place = chosen = subband = 0
    for n, bits in ALLOCATION[name]:
        for subband in range(subband, subband + n):
            shared = subband >= header.bound
            for _ in range(1 if shared else channels):
                place += bits
                chosen += (value >> max(0, size - place) & (1 << bits) - 1 > 0) * (channels if shared else 1)
        subband += 1
    return place + 2 * chosen


def crc_good(frame: bytes, header: Header) -> bool:
    bits = guarded_bits(frame[6:], header)
    return crc16(frame[2:4] + frame[6 : 6 + -(-bits // 8)], -bits % 8) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    """What a stream holds. Offsets are of its audio frames, those of a table not among them."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None
    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def skip(self) -> tuple[int, int]:
        """Samples that the encoder put in front and behind."""
        return ((self.table or {}).get("delay", 0), (self.table or {}).get("padding", 0))

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return Fraction(max(0, self.samples - sum(self.skip)), self.header.rate) if self.header else Fraction(0)

    def seek(self, at: Fraction) -> int | None:
        """The offset of the frame that plays at this time."""
        if not self.offsets or not 0 <= at < self.duration:
            return None
        return self.offsets[(int(at * self.header.rate) + self.skip[0]) // self.header.samples]


def synchsafe(raw: bytes) -> int:
    return (raw[0] & 127) << 21 | (raw[1] & 127) << 14 | (raw[2] & 127) << 7 | raw[3] & 127


def read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads a tag into tags; the place after it, or `at` if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    major, flags, size = data[at + 3], data[at + 5], synchsafe(data[at + 6 : at + 10])
    end, p = at + 10 + size, at + 10
    if flags & 0x40 and len(data) >= p + 4:  # an extended header
        p += synchsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    wide = 6 if major == 2 else 10  # bytes of a frame's own header
    while major in (2, 3, 4) and p + wide <= min(end, len(data)) and data[p]:
        name = data[p : p + wide // 3 + 1].decode("latin-1")
        n = synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8] if major == 3 else data[p + 3 : p + 6], "big")
        body = data[p + wide : min(p + wide + n, end)]
        if name.startswith("T") and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            said, _, value = body[1:].decode(coding, "replace").rstrip("\0").partition("\0")
            named = name in ("TXXX", "TXX")
            tags[f"{name}:{said}" if named else name] = value if named else said
        p += wide + n
    return end + (10 if major == 4 and flags & 0x10 else 0)


def read_table(frame: bytes, header: Header) -> dict[str, object] | None:
    """A Xing, Info or VBRI table, if the frame holds one."""
    p = 4 + 2 * header.protected + header.side
    if frame[p : p + 4] in (b"Xing", b"Info") and len(frame) >= p + 8:
        out: dict[str, object] = {"kind": frame[p : p + 4].decode()}
        flags, p = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", SEEK_POINTS), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(frame[p : p + size]) if name == "toc" else int.from_bytes(frame[p : p + size], "big")
                p += size
        if frame[p : p + 4] in ENCODERS and len(frame) >= p + 24:
            skips = int.from_bytes(frame[p + 21 : p + 24], "big")
            out |= {"encoder": frame[p : p + 9].rstrip(b"\0 ").decode("latin-1"), "delay": skips >> 12, "padding": skips & 0xFFF}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]}
    return None


def free_length(data: bytes, at: int, header: Header, edges: tuple[int, int]) -> int:
    """The bytes, without padding, of the free-format frames that begin here; 0 if no distance leads from header to header."""
    slot = 4 if header.layer == 3 else 1
    near = data.find(b"\xff", at + 24, at + LONGEST_FREE)
    while near >= 0:
        other = read_header(data[near : near + 4])
        if other and other.kind == header.kind:
            length = near - at - header.padding * slot
            after = near + length + other.padding * slot
            third = read_header(data[after : after + 4])
            if after in edges or third and third.kind == header.kind:
                return length
        near = data.find(b"\xff", near + 1, at + LONGEST_FREE)
    return 0


def parse(data: bytes) -> Stream:
    """The stream in any bytes."""
    out = Stream()
    at = 0
    while (after := read_id3v2(data, at, out.tags)) != at:
        at = after
    tag = end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tag = end - 128
    locked, free = False, 0
    while at + 4 <= end and at != tag:
        header = read_header(data[at : at + 4])
        if header and out.header and header.kind != out.header.kind:
            header = None
        length = header.length if header else 0
        if header and header.free:
            free = free or free_length(data, at, header, (tag, end))
            length += free
            header = header if free else None
        after = at + length
        if header and not (locked and after <= tag):  # in step, the next header is looked at in its own turn
            following = read_header(data[after : after + 4])
            if after > end or not (after in (tag, end) or following and following.kind == header.kind):
                header = None
        if not header:
            nearest = data.find(b"\xff", at + 1, tag)
            nearest = tag if nearest < 0 else nearest
            out.skipped += nearest - at
            at, locked = nearest, False
            continue
        locked = True
        tag = tag if after <= tag else end
        frame = data[at:after]
        if out.header is None:
            out.header = header
            if header.layer == 1 and (table := read_table(frame, header)):
                out.table = table
                at = after
                continue
        out.offsets.append(at)
        out.lengths.append(length)
        out.samples += header.samples
        if header.protected:
            good = crc_good(frame, header)
            out.crc_ok += good
            out.crc_bad += not good
        at = after
    out.skipped += max(0, tag - at)
    if tag < end:
        for name, a, b in (("TITLE", 3, 33), ("ARTIST", 33, 63), ("ALBUM", 63, 93)):
            if value := data[tag + a : tag + b].rstrip(b"\0 ").decode("latin-1"):
                out.tags[f"v1:{name}"] = value
    return out


STEREO_KBPS = KBPS[1, 1][1:]
OVERHEAD = 4 + 2 + 32  # header, checksum, side information
RATE_INDEX = 2  # 32 kHz, where every bitrate's frame is a whole number of bytes


def frame_of(kbps: int, body: bytes) -> bytes:
    """A protected silent frame with ancillary bytes."""
    header = bytes([0xFF, 0xFA, KBPS[1, 1].index(kbps) << 4 | RATE_INDEX << 2, 0])
    side = bytes(32)
    length = 144 * kbps * 1000 // RATES[3][RATE_INDEX]
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side + body.ljust(length - OVERHEAD, b"\0")


def room(kbps: int) -> int:
    return 144 * kbps * 1000 // RATES[3][RATE_INDEX] - OVERHEAD


def store(payload: bytes) -> bytes:
    """The payload as a stream."""
    widest = room(STEREO_KBPS[-1])
    frames = []
    for i in range(0, len(payload), widest):
        body = payload[i : i + widest]
        frames.append(frame_of(next(k for k in STEREO_KBPS if room(k) >= len(body)), body))
    total = sum(map(len, frames))
    starts, place = [], 0
    for f in frames:
        starts.append(place)
        place += len(f)
    toc = bytes(min(255, 256 * starts[i * len(frames) // SEEK_POINTS] // total) for i in range(SEEK_POINTS))
    table = b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + bytes(4)
    said = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(said).to_bytes(4, "big") + b"\0\0" + said
    size = bytes(len(tag) >> shift & 127 for shift in (21, 14, 7, 0))
    return b"ID3\3\0\0" + size + tag + frame_of(next(k for k in STEREO_KBPS if room(k) >= len(table)), table) + b"".join(frames)


def load(data: bytes, stream: Stream) -> bytes | None:
    """The payload of a stream made by store(); None of another, or of one that has lost some of it."""
    said = stream.tags.get("TXXX:payload_bytes", "")
    if not said.isdecimal():
        return None
    bodies = b"".join(data[a + OVERHEAD : a + n] for a, n in zip(stream.offsets, stream.lengths))
    return bodies[: int(said)] if len(bodies) >= int(said) else None


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in byte_batches(rows):
            stored = [store(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(t) for t in texts], pa.int64()), pa.array(stored, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


#: What probe adds: names and types.
FEATURES = {
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "duration_samples": pa.int64(),
    "sample_rate": pa.int32(),
    "frame_count": pa.int32(),
    "crc_ok": pa.int32(),
    "crc_bad": pa.int32(),
    "frame_offsets": pa.list_(pa.int64()),
    "feature": pa.string(),
}


def features(data: bytes | None) -> tuple:
    """The values of FEATURES."""
    if data is None:
        return (None,) * len(FEATURES)
    s = parse(data)
    payload = load(data, s)
    own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = len(data), hashlib.sha256(data).hexdigest()
    if not s.offsets:
        return (*own, *stored, *[None] * 7)
    table = s.table or {}
    whole = table.get("frames") == len(s.offsets) and table.get("bytes") == sum(s.lengths)
    said = f"frames={len(s.offsets)};samples={s.samples};rate={s.header.rate};duration={s.duration};crc_ok={s.crc_ok};crc_bad={s.crc_bad};table={table.get('kind')};table_ok={whole};skipped={s.skipped};last={s.offsets[-1]}"
    return (*own, *stored, s.samples - sum(s.skip), s.header.rate, len(s.offsets), s.crc_ok, s.crc_bad, s.offsets, said)


def probe(rows: DataFrame, column: str = "media") -> DataFrame:
    """rows with the stream's features in place of the media column."""
    others = [f for f in rows.schema if f.name != column]
    labels = unused(FEATURES, [f.name for f in others])
    schema = StructType([*others, *[StructField(n, from_arrow_type(t)) for n, t in zip(labels, FEATURES.values())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(v.as_py()) for v in batch.column(len(others))]
            if found:
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], *[pa.array(c, t) for c, t in zip(zip(*found), FEATURES.values())]], schema.names)

    return rows.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{column}`")).mapInArrow(run, schema)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a stream and read back from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return probe(media(docs))
