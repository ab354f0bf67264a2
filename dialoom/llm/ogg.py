"""Ogg media columns: mux bytes into pages, and verify, reassemble, demultiplex and time them again.

A payload of 8-bit samples becomes two interleaved logical streams: the samples, whose granule
position counts samples, and one mark packet for each sample packet, which holds the packet's
CRC-32 and end. Reading scans for capture patterns, verifies each page's checksum, follows page
sequence numbers, rebuilds packets from lacing values across pages, splits the streams by serial
number and derives each packet's time from granule positions.

Defined cases: null text is the empty text; the payload of an empty text is 192 spaces; equal texts
give equal media; a damaged page is dropped and counted, with the packets that it leaves open; a stream's
header is what its page 0 holds, if that begins with the stream's magic, and n_bytes is null if it is lost.
Memory is bounded by one text at a time besides the Arrow batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import col, free_name, text_bytes

UNIT = 192
PACKET = 5 * UNIT
RATE = 8000
SEGMENTS = 30
SAMPLES, MARKS = 0x53414D50, 0x4D41524B
_HEADER = struct.Struct("<4sBBqIIIB")
_SAMPLE_HEAD = struct.Struct("<8sIBB")
_MARK = struct.Struct("<QI")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, most significant bit first, no inversion) by way of zlib's reflected one."""
    got = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return b"".join((head[:22], struct.pack("<I", checksum(head + body)), head[26:], body))


def pages(serial: int, packets: list[tuple[bytes, int]], segments: int = SEGMENTS) -> list[bytes]:
    """The pages of one logical stream of (packet, granule position at its end); the first packet has its own page."""
    out: list[bytes] = []
    for group in (packets[:1], packets[1:]):
        lacing, body, ends = bytearray(), bytearray(), []
        for packet, granule in group:
            lacing += b"\xff" * (len(packet) // 255) + bytes((len(packet) % 255,))
            body += packet
            ends.append((len(lacing), granule))
        at = start = e = 0
        while start < len(lacing):
            part = bytes(lacing[start : start + segments])
            stop, granule, size = start + len(part), -1, sum(part)
            while e < len(ends) and ends[e][0] <= stop:
                granule, e = ends[e][1], e + 1
            flags = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (0 if out else FIRST) | (LAST if stop == len(lacing) and (group is not packets[:1] and len(packets) > 1 and group[-1] is packets[-1]) else 0)
            out.append(_page(serial, len(out), flags, granule, part, bytes(body[at : at + size])))
            at, start = at + size, stop
    return out


def encode(text: bytes) -> bytes:
    """The text, padded with spaces to a positive multiple of 192, as a two-stream Ogg file."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    samples = [(_SAMPLE_HEAD.pack(b"PCM8SAMP", RATE, 8, 1), 0)]
    marks = [(b"PCM8MARK" + struct.pack("<Q", len(text)), 0)]
    for i in range(0, len(payload), PACKET):
        part = payload[i : i + PACKET]
        samples.append((part, i + len(part)))
        marks.append((_MARK.pack(i + len(part), zlib.crc32(part)), i + len(part)))
    a, b = pages(SAMPLES, samples), pages(MARKS, marks)
    out = [a[0], b[0]]  # all first pages stand before any other
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: (packet, end granule) in order, and what was wrong."""

    packets: list[tuple[bytes, int]] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    number: int = -1
    first: int = -1
    rest: bytes | None = None


def demux(media: bytes, spans=len) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the count of pages whose checksum fails.

    A page's granule position belongs to the last packet that ends on it; the ends of the packets
    before it are counted back by ``spans``, a packet's length in granules.
    """
    streams: dict[int, Stream] = {}
    bad, at = 0, media.find(b"OggS")
    while 0 <= at <= len(media) - _HEADER.size:
        _, _, flags, granule, serial, number, crc, count = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if len(lacing) < count or end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            bad, at = bad + 1, media.find(b"OggS", at + 4)
            continue
        s = streams.setdefault(serial, Stream())
        if s.first < 0:
            s.first = number
        if number != s.number + 1:
            s.lost, s.rest = s.lost + max(0, number - s.number - 1), None
        open_ = s.rest if flags & CONTINUED else b""
        done: list[bytes] = []
        pos, size = body, 0
        for x in lacing:
            size += x
            if x < 255:
                if open_ is not None:
                    done.append(open_ + media[pos : pos + size])
                open_, pos, size = b"", pos + size, 0
        s.rest = open_ + media[pos:end] if open_ is not None and lacing[-1:] == b"\xff" else None
        ends = []
        for packet in reversed(done):
            ends.append(granule)
            granule -= spans(packet)
        s.packets += zip(done, reversed(ends))
        s.pages, s.number, s.ended = s.pages + 1, number, bool(flags & LAST)
        at = media.find(b"OggS", end) if media[end : end + 4] != b"OggS" else end
    return streams, bad


def _headed(s: Stream, magic: bytes, size: int) -> tuple[bytes | None, list[tuple[bytes, int]]]:
    """A stream's header, or None if it is lost, and its other packets."""
    if s.first == 0 and s.packets and len(s.packets[0][0]) == size and s.packets[0][0].startswith(magic):
        return s.packets[0][0], s.packets[1:]
    return None, s.packets


def read(media: bytes) -> dict:
    """What one media value holds; ``intact`` tells whether all pages, packets and marks agree."""
    streams, bad = demux(media)
    samples, marks = streams.get(SAMPLES, Stream()), streams.get(MARKS, Stream())
    (head, parts), (mark, checks) = _headed(samples, b"PCM8SAMP", _SAMPLE_HEAD.size), _headed(marks, b"PCM8MARK", 16)
    payload = b"".join(p for p, _ in parts)
    told = [_MARK.unpack(p) for p, _ in checks if len(p) == _MARK.size]
    intact = not bad and head is not None and mark is not None and samples.ended and told == [(g, zlib.crc32(p)) for p, g in parts]
    n_bytes = None if mark is None else struct.unpack("<Q", mark[8:16])[0]
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
    rms = float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = samples.packets[-1][1] if samples.packets else 0
    starts = [g - len(p) for p, g in parts]
    feature = f"streams={len(streams)};pages={samples.pages + marks.pages};packets={len(samples.packets) + len(marks.packets)};bad={bad};lost={samples.lost + marks.lost};intact={int(intact)};seconds={last / RATE:.6f};last_start={(starts or [0])[-1] / RATE:.6f};rms={rms:.6f};crossings={crossings}"
    return {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "intact": intact,
    }


READ_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean"


def _encode(text: pd.Series) -> pd.Series:
    return text.map(encode)


def _read(media: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    rows = [dict.fromkeys(names) if x is None else read(bytes(x)) for x in media]
    found = pd.DataFrame(rows, columns=names)
    return found.astype({"n_bytes": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64", "intact": "boolean"})


def _packets(media: pd.Series) -> pd.Series:
    return media.map(lambda m: [] if m is None else [{"serial": k, "packet": p, "granule": g, "seconds": g / RATE} for k, s in demux(bytes(m))[0].items() for p, g in s.packets])


def media_column(text: str = "text") -> Column:
    """A text column as an Ogg column."""
    return F.pandas_udf(_encode, "binary")(text_bytes(text))


def read_column(media: Column) -> Column:
    """An Ogg column as a struct of ``READ_SCHEMA``; of a null value all is null."""
    return F.pandas_udf(_read, READ_SCHEMA)(media)


def packet_rows(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each packet of each logical stream: the columns but ``media``, serial, packet, granule, seconds.

    Null media has no packets. A new column whose name is taken gets underscores in front.
    """
    rest = [c for c in df.columns if c != media]
    rows = F.pandas_udf(_packets, "array<struct<serial: long, packet: binary, granule: long, seconds: double>>")(col(media))
    names = [free_name(df, c) for c in ("serial", "packet", "granule", "seconds")]
    return df.select(*map(col, rest), F.inline(rows).alias(*names))
