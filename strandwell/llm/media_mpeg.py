"""MPEG audio columns: a codec-free carrier and a frame-exact reader.

`store_payload` packs bytes into an MPEG-1 Layer III stream: an ID3v2 tag, a Xing frame with the frame count and a seek
table, then one checksummed frame for each 576-byte unit, kept in the frame's ancillary data, where a decoder plays
silence and nothing is quantised. `read_streams` reads any stream of MPEG-1, 2 or 2.5: it finds frame headers again after
foreign bytes, parses ID3v1/ID3v2 tags and Xing/Info/VBRI tables with their seek tables, verifies the CRC-16 of Layer I and III frames
(that of Layer II covers fields of a length that only its allocation tables tell; such frames count as unchecked), and gives the exact
duration (each frame by its own rate) and the byte offset of every frame.

Defined results: a null payload is an empty one, and an empty one is padded to one unit; a null stream gives null
columns; bytes without any frame give zero frames, a null sample rate and an empty offset list; of mixed rates, sample_rate is the first
frame's; a table that its frame is too short for is read as far as it goes. Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, slices, tidied

UNIT = 576
PAD = b"\xff"

# Fixed values of the MPEG audio standard: kbit/s by bitrate index 1 to 14, Hz by sampling index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}


class Header:
    """What the four bytes of a frame header say."""

    __slots__ = ("version", "layer", "protected", "kbps", "hz", "mono", "samples", "size", "side", "allocation")

    def __init__(self, version: int, layer: int, protected: bool, kbps: int, hz: int, padding: int, mono: bool, bound: int = 32):
        self.version, self.layer, self.protected, self.kbps, self.hz, self.mono = version, layer, protected, kbps, hz, mono
        low = version != 1
        self.samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
        slot = 4 if layer == 1 else 1
        self.size = (self.samples * kbps * 125 // hz // slot + padding) * slot
        self.side = 0 if layer != 3 else (9 if mono else 17) if low else (17 if mono else 32)
        # Bytes of bit allocation of Layer I, which its checksum covers: 4 bits for each band and channel, shared ones from `bound` on.
        self.allocation = 16 if mono else (bound + 32) // 2


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None if they hold none (free-format streams count as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    kbps = KBPS[1 if version == 1 else 2, layer][rate - 1]
    joint = raw[3] >> 6 == 1
    return Header(version, layer, not raw[1] & 1, kbps, HZ[version][hz], raw[2] >> 1 & 1, raw[3] >> 6 == 3, 4 * (raw[3] >> 4 & 3) + 4 if joint else 32)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, all ones at the start) of each row of bytes."""
    value = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for k in range(rows.shape[1]):
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[(value >> 8) ^ rows[:, k]]
    return value


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x00" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def payload_of(text: bytes) -> bytes:
    """The bytes, padded with 255 to a positive multiple of the unit."""
    return text + PAD * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


# The carrier frame: MPEG-1 Layer III, stereo, 48 kHz, 224 kbit/s, with checksum; 672 bytes hold a unit behind 38.
CARRIER = b"\xff\xfa\xc4\x00"
INFO = b"\xff\xfb\xc4\x00"
LEAD = 4 + 2 + 32


def store_payload(payload: bytes, length: int) -> bytes:
    """The stream that carries a payload of whole units; `length` is the number of its bytes before padding."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    shape = header(CARRIER)
    frames = np.zeros((len(units), shape.size), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(CARRIER, dtype=np.uint8)
    checked = np.zeros((1, 2 + shape.side), dtype=np.uint8)
    checked[0, :2] = np.frombuffer(CARRIER[2:], dtype=np.uint8)
    crc = int(crc16(checked)[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[:, LEAD : LEAD + UNIT] = units
    total = shape.size * (len(units) + 1)
    toc = bytes(min(255, (shape.size * (1 + len(units) * k // 100) * 256) // total) for k in range(100))
    info = INFO + bytes(shape.side) + b"Xing" + struct.pack(">III", 7, len(units), total) + toc
    tags = _text_frame(b"TXXX", f"bytes\x00{length}") + _text_frame(b"TLEN", str(len(units) * shape.samples * 1000 // shape.hz))
    return b"ID3\x03\x00\x00" + _syncsafe(len(tags)) + tags + info.ljust(shape.size, b"\x00") + frames.tobytes()


def _sizes(raw: bytes) -> int:
    """A size of seven bits to a byte."""
    total = 0
    for byte in raw:
        total = total << 7 | byte & 127
    return total


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio begins, and the text frames of an ID3v2.2, 2.3 or 2.4 tag, unsynchronisation taken back."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x > 127 for x in data[6:10]):
        return 0, {}
    version, flags, size, tags = data[3], data[5], _sizes(data[6:10]), {}
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos, wide = 0, 3 if version == 2 else 4
    if flags & 0x40 and version > 2 and len(body) >= 4:
        pos = int.from_bytes(body[:4], "big") + 4 if version == 3 else _sizes(body[:4])
    head = 2 * wide if version == 2 else 2 * wide + 2
    while pos + head <= len(body) and body[pos] and version in (2, 3, 4):
        name, raw = body[pos : pos + wide], body[pos + wide : pos + 2 * wide]
        n = _sizes(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[pos + head : pos + head + n]
        if version == 4 and body[pos + 9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        pos += head + n
        if name[:1] == b"T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            text = value[1:].decode(code, "replace").rstrip("\x00")
            key, _, rest = text.partition("\x00")
            free = name in (b"TXXX", b"TXX")
            tags[f"TXXX:{key}" if free else name.decode("latin-1")] = rest.lstrip("\ufeff") if free else text
    return 10 + size + (10 if flags & 0x10 else 0), tags


def _id3v1(tag: bytes) -> dict[str, str]:
    """The fields of the 128 bytes of an ID3v1 tag, by the names of ID3v2.3; a track number if the comment ends in one."""
    text = lambda raw: raw.partition(b"\x00")[0].decode("latin-1").rstrip()
    found = {"TIT2": text(tag[3:33]), "TPE1": text(tag[33:63]), "TALB": text(tag[63:93]), "TYER": text(tag[93:97]), "COMM": text(tag[97:127])}
    if not tag[125] and tag[126]:
        found["TRCK"] = str(tag[126])
    return {k: v for k, v in found.items() if v}


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of the frame at `at`, or None; fields that the frame is too short for are None.

    `toc` has the share of the bytes (of 256) at each hundredth of the time (Xing) or the bytes of each stretch of frames (VBRI); `delay` and
    `padding` are the samples that the encoder put before and behind the sound."""
    frame = data[at : at + h.size]
    for skip in (h.side, h.side + 2 * h.protected):
        pos = 4 + skip
        if frame[pos : pos + 4] in (b"Xing", b"Info"):
            found = {"kind": frame[pos : pos + 4].decode(), "frames": None, "bytes": None, "toc": None, "delay": None, "padding": None}
            flags, pos = int.from_bytes(frame[pos + 4 : pos + 8], "big") if len(frame) >= pos + 8 else 0, pos + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= pos + 4:
                    found[key], pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
            if flags & 4 and len(frame) >= pos + 100:
                found["toc"], pos = tuple(frame[pos : pos + 100]), pos + 100
            pos += 4 if flags & 8 else 0
            if frame[pos : pos + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= pos + 24:
                both = int.from_bytes(frame[pos + 21 : pos + 24], "big")
                found["delay"], found["padding"] = both >> 12, both & 0xFFF
            return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, _ = struct.unpack(">HHHH", frame[54:62])
        table = frame[62 : 62 + entries * width]
        whole = width in (1, 2, 3, 4) and len(table) == entries * width
        toc = tuple(int.from_bytes(table[k : k + width], "big") * scale for k in range(0, len(table), width)) if whole else None
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "delay": int.from_bytes(frame[42:44], "big"), "padding": None}
    return None


def _frames(data: bytes, start: int, end: int) -> tuple[list[int], list[Header], int]:
    """Offsets and headers of the frames from start to end, and the bytes skipped between them."""
    offsets, shapes, pos, skipped = [], [], start, 0
    locked = False
    while 0 <= pos and pos + 4 <= end:
        h = header(data[pos : pos + 4])
        after = pos + h.size if h else 0
        # A header counts if the stream is in step with it, or if another one or the end follows where it says.
        if h and h.size > 4 and after <= end and (locked or after == end or header(data[after : after + 4])):
            offsets.append(pos)
            shapes.append(h)
            pos, locked = after, True
            continue
        found = data.find(b"\xff", pos + 1, end)
        skipped += (found if found >= 0 else end) - pos
        pos, locked = found, False
    return offsets, shapes, skipped


def parse(data: bytes) -> dict:
    """Tags, tables, frame offsets, exact duration and checksum results of a stream."""
    start, tags = _id3v2(data)
    end = len(data)
    offsets, shapes, skipped = _frames(data, start, end)
    at = end - 128
    # 'TAG' inside a frame is its content; only behind the frames it is an ID3v1 tag.
    if at >= start and data[at : at + 3] == b"TAG" and not any(o < at < o + h.size for o, h in zip(offsets, shapes, strict=True)):
        for name, value in _id3v1(data[at:end]).items():
            tags.setdefault(name, value)
        offsets, shapes, skipped = _frames(data, start, at)
    vbr = _vbr(data, offsets[0], shapes[0]) if offsets else None
    if vbr:
        offsets, shapes = offsets[1:], shapes[1:]
    raw = np.frombuffer(data, dtype=np.uint8)
    bad = checked = 0
    for o, h in zip(offsets, shapes, strict=True):
        if h.protected and h.layer == 1 and h.size >= 6 + h.allocation:
            span = np.r_[raw[o + 2 : o + 4], raw[o + 6 : o + 6 + h.allocation]]
            bad, checked = bad + (int(crc16(span[None, :])[0]) != int(raw[o + 4]) << 8 | int(raw[o + 5])), checked + 1
    for side in {h.side for h in shapes if h.protected and h.layer == 3}:
        at = np.array([o for o, h in zip(offsets, shapes, strict=True) if h.protected and h.layer == 3 and h.side == side and h.size >= 6 + side])
        if len(at):
            span = raw[at[:, None] + np.r_[2, 3, 6 : 6 + side]]
            want = raw[at + 4].astype(np.uint32) << 8 | raw[at + 5]
            bad, checked = bad + int((crc16(span) != want).sum()), checked + len(at)
    return {
        "tags": tags, "vbr": vbr, "offsets": offsets, "shapes": shapes, "skipped": skipped, "crc_checked": checked, "crc_bad": bad,
        "samples": sum(h.samples for h in shapes), "hz": shapes[0].hz if shapes else None, "micros": _micros(shapes),
    }


def _micros(shapes: list[Header]) -> int | None:
    """The microseconds of the frames, each by its own rate, rounded down once; None without frames."""
    if not shapes:
        return None
    by_rate = Counter()
    for h in shapes:
        by_rate[h.hz] += h.samples
    return int(sum(Fraction(n * 1_000_000, hz) for hz, n in by_rate.items()))


def carried(data: bytes, found: dict) -> bytes:
    """The units in the ancillary data of a stream made by `store_payload`; frames of any other kind carry none."""
    at = np.array([o for o in found["offsets"] if data[o : o + 4] == CARRIER], dtype=np.int64)
    if not len(at):
        return b""
    return np.frombuffer(data, dtype=np.uint8)[at[:, None] + np.arange(LEAD, LEAD + UNIT)].tobytes()


STORED = "doc_id long, n_bytes long, media binary"


def store_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream that holds the padded UTF-8 text of each row, written as a table of the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                media = [store_payload(payload_of(t), len(t)) for t in texts]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(tidied(pack), STORED), "mpeg-streams")


READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, samples long, sample_rate int, duration_us long, crc_checked long, crc_bad long, seek_offsets array<long>"
)


def features(data: bytes) -> tuple:
    """The columns of READ after n_bytes for one stream."""
    found = parse(data)
    payload = carried(data, found)
    offsets, vbr, hz = found["offsets"], found["vbr"], found["hz"]
    seek = zlib.crc32(np.array(offsets, dtype="<i8").tobytes())
    table = "none" if vbr is None else "ok" if vbr["frames"] == len(offsets) else "differs"
    first = found["shapes"][0] if found["shapes"] else None
    said = (
        f"mpeg{first.version if first else 0};layer{first.layer if first else 0};{hz or 0}Hz;{1 if first and first.mono else 2}ch;frames={len(offsets)};"
        f"samples={found['samples']};crc_bad={found['crc_bad']}/{found['crc_checked']};vbr={table};skipped={found['skipped']};"
        f"tag_bytes={found['tags'].get('TXXX:bytes', '')};seek_crc={seek:08x}"
    )
    micros = found["micros"] or 0
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), said,
        len(offsets), found["samples"], hz, micros, found["crc_checked"], found["crc_bad"], offsets,
    )


def read_streams(stored: DataFrame) -> DataFrame:
    """What the reader finds in the stored streams: payload digests, exact durations, checksum results and seek offsets."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("samples", pa.int64()),
        ("sample_rate", pa.int32()), ("duration_us", pa.int64()), ("crc_checked", pa.int64()), ("crc_bad", pa.int64()), ("seek_offsets", pa.list_(pa.int64())),
    ])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [features(m) if m is not None else (None,) * 13 for m in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1)]
                columns += [pa.array([f[k] for f in found], schema.field(k + 2).type) for k in range(13)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidied(unpack), READ)
