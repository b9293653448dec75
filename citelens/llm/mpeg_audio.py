"""MPEG audio columns: write payloads as variable-bitrate MPEG-1 layer III streams, and read any MPEG audio stream back.

The reader resynchronises on frame headers of layers I to III.  A header counts if the next one stands where its frame ends
or the stream does, if the frame's checksum holds, or if it follows a frame that counts without a gap, so a sound frame
before damage is kept.  It parses ID3v2.2 to 2.4 tags (extended header, unsynchronisation, footer) and ID3v1, the Xing/Info
and VBRI variable-bitrate tables, verifies the checksum of protected layer III frames (``checked`` counts those), and gives
exact durations (samples / sampling rate as whole numbers) and the seek offset of every frame.  Free-format frames, whose
size no header states, are skipped.

The writer stores bytes losslessly in the frames' main data: side information is all zero, so a decoder plays silence and
passes over the data as ancillary.  Every frame is protected; the last takes the smallest bitrate that holds the rest.

Both are one Arrow map a column: no shuffle, one value at a time, and ``ROWS`` values at most wait to go back to Spark.

Defined results: a null column value is an empty payload for the writer and an unreadable stream (no frames) for the reader;
bytes that are no stream, cut or damaged tags and frames give what could be read and count the rest as skipped, and never
raise; a stream without the writer's length tag has an empty payload; equal values give equal results.  Both are columns,
so the other columns of a table, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the MPEG audio frame header: kbit/s by index for each layer, and sampling rates.
KBITS_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_V1_LAYER2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
KBITS_V1_LAYER1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
KBITS_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
KBITS_V2_LAYER1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
POLYNOMIAL = 0x8005
#: Results of this many values go back to Spark at a time, so that an Arrow batch is not held twice as a whole.
ROWS = 256


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    protected: bool
    kbits: int
    rate: int
    size: int
    samples: int
    side: int
    layer: int = 3


@dataclass
class Stream:
    headers: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    checked: int = 0
    sound: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    table_at: int | None = None

    @property
    def audio(self) -> list[int]:
        """Frames that carry sound: all but the table's."""
        return [i for i, o in enumerate(self.offsets) if o != self.table_at]


@lru_cache(maxsize=4096)
def parse_header(raw: bytes) -> Header | None:
    """A frame header, or None."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first, padding = version == 3, raw[2] >> 1 & 1
    hz = RATES[version][rate]
    if layer == 1:
        kbits = (KBITS_V1_LAYER1 if first else KBITS_V2_LAYER1)[index]
        return Header(version, not raw[1] & 1, kbits, hz, 4 * (12 * kbits * 1000 // hz + padding), 384, 0, layer)
    kbits = ((KBITS_V1 if layer == 3 else KBITS_V1_LAYER2) if first else KBITS_V2)[index]
    samples = 1152 if first or layer == 2 else 576
    mono = raw[3] >> 6 == 3
    side = 0 if layer == 2 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, not raw[1] & 1, kbits, hz, samples // 8 * kbits * 1000 // hz + padding, samples, side, layer)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The frame checksum, over the header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, out: Stream) -> int:
    """Length of a leading tag; text frames go to out.tags."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    version, flags, size = data[3], data[5], _synchsafe(data[6:10])
    end = min(len(data), 10 + size)
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:  # the extended header's own length: with itself from 2.4 on
        at = _synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + name_size].isalnum():
        raw = body[at + name_size : at + 2 * name_size]
        length = _synchsafe(raw) if version == 4 and max(raw) < 128 else int.from_bytes(raw, "big")
        text = body[at + head : at + head + length]
        if version == 4 and (flags & 0x80 or body[at + 9] & 2):
            text = text.replace(b"\xff\x00", b"\xff")
        if body[at : at + 1] == b"T" and text:
            decoded = text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8"), "replace")
            name, _, value = decoded.partition("\0")
            frame = "TXXX" if body[at : at + 3] == b"TXX" else body[at : at + name_size].decode("latin-1")
            out.tags[frame + (f":{name}" if value else "")] = (value or name).rstrip("\0")
        at += head + length
    return min(len(data), end + 10) if flags & 0x10 and version == 4 else end


def _checksum_holds(data: bytes, at: int, head: Header) -> bool:
    body = at + 6
    return crc16(data[at + 2 : at + 4] + data[body : body + head.side]) == int.from_bytes(data[at + 4 : at + 6], "big")


def parse_stream(data: bytes) -> Stream:
    out = Stream()
    at, end = _id3v2(data, out), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1")
    previous: Header | None = None  # of the frame that ends here
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        after = at + head.size if head else 0
        fits = head is not None and at + 4 + 2 * head.protected + head.side <= after <= end
        checked = fits and head.protected and head.layer == 3
        sound = checked and _checksum_holds(data, at, head)
        follows = fits and previous is not None and (previous.version, previous.layer, previous.rate) == (head.version, head.layer, head.rate)
        if not fits or not (sound or follows or after == end or parse_header(data[after : after + 4])):
            step = data.find(b"\xff", at + 1, end)  # resynchronise
            out.skipped += (end if step < 0 else step) - at
            at, previous = end if step < 0 else step, None
            continue
        out.checked += checked
        out.sound += sound
        if not out.offsets and _vbr_table(data, at, head, out):
            out.table_at = at
        out.headers.append(head)
        out.offsets.append(at)
        at, previous = after, head
    out.skipped += max(0, end - at)
    return out


def _vbr_table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Whether a frame is a variable-bitrate table; its counts go to out."""
    after, place = at + head.size, at + 4 + 2 * head.protected + head.side
    number = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    if data[place : place + 4] in (b"Xing", b"Info"):
        flags, place = number(place + 4), place + 8
        if flags & 1:
            out.vbr_frames, place = number(place), place + 4
        if flags & 2:
            out.vbr_bytes, place = number(place), place + 4
        if flags & 4:
            out.toc = data[place : min(place + 100, after)]
        return True
    if data[at + 36 : at + 40] == b"VBRI":  # always 32 bytes behind the header
        out.vbr_bytes, out.vbr_frames = number(at + 46), number(at + 50)
        out.toc = data[at + 62 : min(at + 62 + number(at + 54, 2) * number(at + 58, 2), after)]
        return True
    return False


def _frame(index: int, body: bytes, size: int, side: int = 17) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))  # MPEG-1 layer III, protected, 32 kHz, mono
    return (head + crc16(head[2:] + bytes(side)).to_bytes(2, "big") + bytes(side) + body).ljust(size, b"\0")


def _sizes() -> list[int]:
    return [0, *(144 * k * 1000 // 32000 for k in KBITS_V1[1:])]


def write_stream(payload: bytes) -> bytes:
    """ID3v2 tag with the payload's length, Xing frame, then the payload in variable-bitrate frames."""
    sizes = _sizes()
    room = [s - 23 for s in sizes]
    frames, at = [], 0
    while at < len(payload):
        rest = len(payload) - at
        index = next((i for i in range(1, 15) if room[i] >= rest), 14)
        frames.append(_frame(index, payload[at : at + room[index]], sizes[index]))
        at += room[index]
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    length = len(tag)
    tag = b"ID3\x03\0\0" + bytes((length >> 21 & 127, length >> 14 & 127, length >> 7 & 127, length & 127)) + tag
    table_size = sizes[9]
    total = table_size + sum(map(len, frames))
    ends = np.concatenate([[0], np.cumsum([len(f) for f in frames])]) + table_size
    toc = bytes(min(255, int(256 * ends[min(len(frames), i * len(frames) // 100)] // max(total, 1))) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag + _frame(9, table, table_size) + b"".join(frames)


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The bytes that write_stream stored."""
    stated = stream.tags.get("TXXX:payload_bytes", "0")
    n = int(stated) if stated.isascii() and stated.isdigit() else 0
    parts = (data[stream.offsets[i] + 4 + 2 * (h := stream.headers[i]).protected + h.side : stream.offsets[i] + h.size] for i in stream.audio)
    return b"".join(parts)[:n]


def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS].map(lambda p: write_stream(p or b""))


FIELDS = "n_frames long, samples long, rate long, duration double, min_kbits int, max_kbits int, checked long, sound long, skipped long, vbr_frames long, tags map<string,string>, offsets array<long>, payload binary"


def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield pd.DataFrame([_row(m) for m in batch.iloc[at : at + ROWS]], columns=[f.split(" ")[0] for f in FIELDS.split(", ")])


def _row(media: bytes | None) -> tuple:
    data = media or b""
    s = parse_stream(data)
    heads = [s.headers[i] for i in s.audio]
    samples, rate = sum(h.samples for h in heads), heads[0].rate if heads else 0
    seconds = sum(h.samples / h.rate for h in heads) if len({h.rate for h in heads}) > 1 else (samples / rate if rate else 0.0)
    kbits = [h.kbits for h in heads] or [0]
    return len(heads), samples, rate, seconds, min(kbits), max(kbits), s.checked, s.sound, s.skipped, s.vbr_frames, s.tags, [s.offsets[i] for i in s.audio], read_payload(data, s)


def encode_audio(payload: Column) -> Column:
    """Binary payload -> MPEG audio stream that holds it."""
    return F.pandas_udf(_encode, "binary")(payload)


def decode_audio(media: Column) -> Column:
    """MPEG audio stream -> struct of frames, exact duration, checks, tags, seek offsets and stored payload (see FIELDS)."""
    return F.pandas_udf(_decode, FIELDS)(media)
