"""MPEG audio as a column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, frugal

# Fixed values of the MPEG audio standards: kbit/s by bitrate index 1 to 14, Hz by sampling index.
_KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
_VERSION = {3: 1, 2: 2, 0: 2.5}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    hertz: int
    channels: int
    size: int
    samples: int
    side: int
    covered: int | None  #: bytes after the checksum that it covers, besides the header; not known for layer II

    @property
    def stream(self) -> tuple:
        return self.version, self.layer, self.hertz


def _parse_header(word: bytes) -> Header | None:
    bits = int.from_bytes(word, "big")
    if len(word) < 4 or bits >> 21 != 0x7FF:
        return None
    version, layer = _VERSION.get(bits >> 19 & 3), 4 - (bits >> 17 & 3)
    rate, hertz = bits >> 12 & 15, bits >> 10 & 3
    if version is None or layer == 4 or not 1 <= rate <= 14 or hertz == 3:
        return None
    kbps, hz = _KBPS[(1 if version == 1 else 2, layer)][rate - 1], _HERTZ[version][hertz]
    channels, padding = 1 if bits >> 6 & 3 == 3 else 2, bits >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12_000 * kbps // hz + padding) * 4 if layer == 1 else samples * 125 * kbps // hz + padding
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
    # layer I: four bits of allocation for each subband, shared by both channels above the bound of joint stereo
    bound = 4 + 4 * (bits >> 4 & 3) if bits >> 6 & 3 == 1 else 32
    covered = {1: 16 if channels == 1 else (32 + bound) // 2, 2: None, 3: side}[layer]
    return Header(version, layer, not bits >> 16 & 1, kbps, hz, channels, size, samples, side, covered)


_headers: dict[bytes, Header | None] = {}
_checks: dict[bytes, int] = {}


def header(word: bytes) -> Header | None:
    """The frame header in these four bytes, if they hold one (free format counts as none)."""
    if word not in _headers:
        if len(_headers) > 50_000:
            _headers.clear()
        _headers[word] = _parse_header(word)
    return _headers[word]


def crc16(data: bytes) -> int:
    """The standard's checksum: polynomial 0x8005, all ones at first."""
    if data not in _checks:
        if len(_checks) > 50_000:
            _checks.clear()
        crc = 0xFFFF
        for byte in data:
            crc ^= byte << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        _checks[data] = crc
    return _checks[data]


@dataclass
class Stream:
    """What one stored stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    kbps: set[int] = field(default_factory=set)
    first: Header | None = None
    samples: int = 0
    checked: int = 0
    broken: int = 0
    unchecked: int = 0
    skipped: int = 0
    resyncs: int = 0
    payload: bytes | None = None


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read a leading tag's text frames, of versions 2.2 to 2.4; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    body = data[10 : 10 + size]
    end = 10 + size + 10 * bool(version >= 4 and flags & 0x10)
    if version not in (2, 3, 4) or (version == 2 and flags & 0x40):
        return end  # of another kind, or compressed as a whole
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4:  # an extended header: its size counts itself from 2.4 on
        at = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    wide, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name = body[at : at + wide].decode("latin-1")
        n = _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + wide : at + 2 * wide], "big")
        value = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 0x02:
            value = value.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 0x01:
            value = value[4:]
        if name[0] == "T" and value:
            text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace").rstrip("\0")
            key, _, text = text.partition("\0") if name in ("TXX", "TXXX") else (name, "", text)
            tags[key] = text
        at += head + n
    return end


def _id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Read a trailing tag; where it begins."""
    if data[-128:-125] != b"TAG" or len(data) < 128:
        return len(data)
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
        value = data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip()
        if value:
            tags.setdefault(name, value)
    return len(data) - 128


def _vbr_table(frame: bytes, head: Header) -> dict | None:
    """A Xing, Info or VBRI table in the first frame."""
    at = 4 + 2 * head.protected + head.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out: dict = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "frames": int.from_bytes(frame[50:54], "big"), "bytes": int.from_bytes(frame[46:50], "big"), "toc": None}
    return None


def parse(data: bytes) -> Stream:
    """Walk the frames; after damage, go on at the next header that another frame, or the end, confirms.

    Checksums are verified over what they cover in layers I and III; frames of
    layer II, whose cover depends on allocation tables, count as unchecked. The
    payload is read from streams that ``write`` marked, null from others.
    """
    out = Stream()
    at, end = _id3v2(data, out.tags), _id3v1(data, out.tags)
    stored, lost = [], False
    while at + 4 <= end:
        head = header(data[at : at + 4])
        good = head is not None and at + head.size <= end and (out.first is None or head.stream == out.first.stream)
        if good and (lost or out.first is None) and at + head.size < end:
            after = header(data[at + head.size : at + head.size + 4])
            good = after is not None and after.stream == head.stream
        if not good:
            out.resyncs += not lost
            lost = True
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        lost = False
        frame = data[at : at + head.size]
        if head.protected and head.covered is None:
            out.unchecked += 1
        elif head.protected:
            if crc16(frame[2:4] + frame[6 : 6 + head.covered]) == int.from_bytes(frame[4:6], "big"):
                out.checked += 1
            else:
                out.broken += 1
        if out.first is None:
            out.first = head
            out.table = _vbr_table(frame, head)
            if out.table:
                at += head.size
                continue
        out.offsets.append(at)
        out.kbps.add(head.kbps)
        out.samples += head.samples
        body = 4 + 2 * head.protected + head.side
        held = int.from_bytes(frame[body : body + 2], "big")
        stored.append(frame[body + 2 : body + 2 + held])
        at += head.size
    out.skipped += max(0, end - at)
    if out.tags.pop(_MARK, None) is not None:
        out.payload = b"".join(stored)
    return out


_MARK = "ancillary payload"
_RATES = _KBPS[(1, 3)]
_OVERHEAD = 4 + 2 + 17 + 2


def _frame(kbps: int, body: bytes) -> bytes:
    """A silent 48 kHz mono layer III frame with a checksum; ``body`` fills its ancillary data."""
    head = bytes((0xFF, 0xFA, (_RATES.index(kbps) + 1) << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return (head + crc16(head[2:] + side).to_bytes(2, "big") + side + body).ljust(3 * kbps, b"\0")


def write(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A variable-bitrate layer III stream that plays as silence and carries ``payload`` in its ancillary data.

    Frames of 320 kbit/s hold 935 bytes each, the last one takes the smallest
    bitrate that fits; a Xing table and an ID3v2.4 tag stand before them.
    """
    room, frames = 3 * 320 - _OVERHEAD, []
    for i in range(0, len(payload), room):
        part = payload[i : i + room]
        kbps = next(k for k in _RATES if 3 * k - _OVERHEAD >= len(part))
        frames.append(_frame(kbps, len(part).to_bytes(2, "big") + part))
    size = sum(map(len, frames))
    first, starts, at = 3 * 64, [], 0
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * (first + starts[len(frames) * i // 100]) // (first + size)) for i in range(100)) if frames else bytes(100)
    xing = _frame(64, b"Xing" + struct.pack(">III", 7, len(frames), first + size) + toc)
    body = b""
    for key, value in {**(tags or {}), _MARK: "1"}.items():
        text = b"\3" + (f"{key}\0{value}" if len(key) != 4 else value).encode()
        n = len(text)
        body += (key if len(key) == 4 else "TXXX").encode() + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + text
    n = len(body)
    tag = b"ID3\4\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body if body else b""
    return tag + xing + b"".join(frames)


def to_mpeg(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Store every whole text as an MPEG stream.

    Reads doc_id and text; other columns are ignored. The payload is the UTF-8
    text (null: empty) with zero bytes up to a positive multiple of ``unit``,
    which is 1 at least. Returns doc_id, n_bytes (of the text) and media
    (binary), 2.7 % larger than the payload for long texts: texts from about
    2,080,000,000 bytes on do not fit the two gigabytes of a value and fail.
    Equal texts give equal streams; an empty table stays empty.
    """
    if unit < 1:
        raise ValueError("unit is 1 or more")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [write(t.ljust(max(unit, -(-len(t) // unit) * unit), b"\0"), {"n_bytes": str(len(t))}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n_bytes long, media binary")


_READ = (
    "doc_id long, n_bytes long, media binary, payload binary, version double, layer int, hertz int, channels int, n_frames long, n_samples long, "
    "seconds double, crc_good long, crc_bad long, crc_unchecked long, resyncs long, skipped long, table_kind string, table_frames long, seek array<long>, kbps array<int>, tags map<string,string>"
)


def read_mpeg(media: DataFrame) -> DataFrame:
    """Parse a media column: one row for each of ``media(doc_id, n_bytes, media)``.

    Adds the ancillary payload (null for streams of other makers), the exact
    duration (n_samples over hertz), the byte offset of every frame, checksum
    counts, what resynchronisation skipped, the variable-bitrate table and the
    tags. Null media reads as an empty stream: no frames, null payload, version,
    layer, hertz and channels. A null n_bytes stays null; other columns are
    ignored; an empty table stays empty.
    """
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = parse(data or b"")
                h, t = s.first, s.table or {}
                rows.append(
                    (doc_id, n_bytes, data, s.payload, h and float(h.version), h and h.layer, h and h.hertz, h and h.channels, len(s.offsets), s.samples, s.samples / h.hertz if h else 0.0,
                     s.checked, s.broken, s.unchecked, s.resyncs, s.skipped, t.get("kind"), t.get("frames"), s.offsets, sorted(s.kbps), list(s.tags.items()))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _read_schema, strict=True)], schema=_read_schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(frugal(run), _READ)


_read_schema = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("version", pa.float64()), ("layer", pa.int32()), ("hertz", pa.int32()), ("channels", pa.int32()),
     ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("seconds", pa.float64()), ("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("crc_unchecked", pa.int64()), ("resyncs", pa.int64()), ("skipped", pa.int64()),
     ("table_kind", pa.string()), ("table_frames", pa.int64()), ("seek", pa.list_(pa.int64())), ("kbps", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string()))]
)
