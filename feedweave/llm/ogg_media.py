"""Media columns (operator 1): Ogg bitstreams in binary columns.

``mux`` writes payload bytes as 8-bit unsigned PCM at 8000 Hz into two interleaved logical streams of one physical Ogg
bitstream, as left and right channels: even bytes in the first, odd ones in the second, in packets of different lengths,
so that pages hold several packets and long packets span pages. ``demux`` reads any Ogg bitstream: it verifies every page
checksum, reassembles packets from lacing values, separates the logical streams by serial number, and derives packet
timestamps: a page's granule position is the end of the last packet that ends on it, and those before it are counted back
by their lengths. ``packets`` explodes a media column into packet rows.

Page checksums use the unreflected polynomial 0x04C11DB7; they are computed with zlib on bit-reversed bytes, so the cost
is that of two passes in C, not of a Python loop.

Defined cases: null text counts as empty, and an empty payload is padded to 64 zero bytes; a null media value gives no
packets; a damaged page raises OggError in ``demux`` and gives an error string in ``packets``; a page whose granule
position does not fit its packets (one without a packet's end that has a position, or the reverse) is damaged; packets of
PCM and Opus streams are counted back, those of others have a time only where a page ends, and seconds need a stream whose
header names its rate (PCM, Opus, Vorbis); equal texts give equal bytes; very long texts are stored whole; memory
holds one text and its media form at a time within a batch; repeated rows give repeated results; an empty table gives an
empty result; ``store`` and ``packets`` read their own columns by place, so no other column's name can clash with theirs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedweave.llm.common import documents

RATE = 8000
#: Samples a packet, in turn: several short packets share a page, the longest spans pages (65,025 bytes at most each).
PACKETS = (200, 700, 3000, 66_000)
#: Names of stream headers; Opus: granules a second and samples of a frame by its kind.
PCM_NAME, OPUS_NAME, VORBIS_NAME = b"PCM     ", b"OpusHead", b"\x01vorbis"
OPUS_RATE = 48_000
OPUS_SILK, OPUS_CELT = (480, 960, 1920, 2880), (120, 240, 480, 960)
PAGE_SEGMENTS = 255
BLOCK = 64
CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
PCM_HEAD = struct.Struct("<8sHHIIBBHI")
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


class OggError(ValueError):
    """A page or stream that breaks the format."""


def page_crc(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: polynomial 0x04C11DB7, start 0, no reflection, no final inversion."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes((-len(raw)) % BLOCK or (0 if raw else BLOCK))


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


class _Writer:
    """One logical stream: packets in, pages out as they fill."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), -1, False

    def page(self, flags: int = 0) -> bytes:
        """What has gathered, as one page."""
        out = _page((1 if self.open else 0) | (2 if not self.number else 0) | flags, self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body))
        self.number += 1
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.lacing, self.body, self.granule = bytearray(), bytearray(), -1
        return out

    def pages(self, packet: bytes, granule: int, *, flush: bool = False, last: bool = False) -> Iterator[bytes]:
        """The pages that a packet which ends at granule fills; with flush or last also the one it ends on."""
        lacing, at, done = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255]), 0, 0
        while done < len(lacing):
            if len(self.lacing) == PAGE_SEGMENTS:
                yield self.page()
            part = lacing[done : done + PAGE_SEGMENTS - len(self.lacing)]
            n = sum(part)
            self.lacing += part
            self.body += packet[at : at + n]
            done, at = done + len(part), at + n
        self.granule = granule
        if flush or last:
            yield self.page(4 if last else 0)


def mux(payload: bytes, rate: int = RATE, packets: tuple[int, ...] = PACKETS) -> bytes:
    """Even and odd samples in two logical streams on one clock, their pages by time; granule positions are sample ends."""
    out: list[bytes] = []
    timed: list[tuple[int, int, list[bytes]]] = []
    writers = [_Writer(1), _Writer(2)]
    for w in writers:
        out += w.pages(PCM_HEAD.pack(PCM_NAME, 0, 0, 1, rate, 8, 1, 1, 0), 0, flush=True)
    for side, w in enumerate(writers):
        samples, at, k = payload[side::2], 0, 0
        while True:
            cut = samples[at : at + packets[k % len(packets)]]
            at, k = at + len(cut), k + 1
            timed.append((at, side, list(w.pages(cut, at, last=at == len(samples)))))
            if at == len(samples):
                break
    timed.sort(key=lambda x: x[:2])
    return b"".join([*out, *(p for _, _, pages in timed for p in pages)])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position of each packet's end; -1: not known
    page_ends: list[tuple[int, int]] = field(default_factory=list)  # packets that had ended with a page, its granule position
    pages: int = 0
    ended: bool = False

    @property
    def head(self) -> bytes:
        return self.packets[0] if self.packets else b""

    @property
    def pcm(self) -> bool:
        return self.head[:8] == PCM_NAME

    @property
    def opus(self) -> bool:
        return self.head[:8] == OPUS_NAME and len(self.head) >= 19

    @property
    def clock(self) -> tuple[int, int] | None:
        """Granules a second, and how many come before time 0; None where the header does not tell."""
        if self.pcm and len(self.head) >= PCM_HEAD.size:
            return PCM_HEAD.unpack_from(self.head)[4], 0
        if self.opus:
            return OPUS_RATE, int.from_bytes(self.head[10:12], "little")
        if self.head[:7] == VORBIS_NAME and len(self.head) >= 16:
            return int.from_bytes(self.head[12:16], "little"), 0
        return None

    def seconds(self, granule: int) -> float | None:
        clock = self.clock
        return max(0, granule - clock[1]) / clock[0] if clock and clock[0] and granule >= 0 else None

    def lengths(self) -> list[int] | None:
        """Granules of each packet, headers without any; None for streams whose packets do not tell."""
        if self.pcm:
            frame = 1
            if len(self.head) >= PCM_HEAD.size:
                *_, bits, channels, _, _ = PCM_HEAD.unpack_from(self.head)
                frame = max(1, bits // 8 * channels)
            return [0, *(len(p) // frame for p in self.packets[1:])]
        return [0, 0, *map(opus_length, self.packets[2:])][: len(self.packets)] if self.opus else None


def opus_length(packet: bytes) -> int:
    """Samples at 48 kHz of an Opus packet, by its first bytes: the frame's size and how many there are."""
    if not packet:
        return 0
    kind, count = packet[0] >> 3, (1, 2, 2, packet[1] & 63 if len(packet) > 1 else 0)[packet[0] & 3]
    return count * (OPUS_SILK[kind & 3] if kind < 12 else OPUS_SILK[kind & 1] if kind < 16 else OPUS_CELT[kind & 3])


def _timed(s: Stream) -> None:
    """Ends of all packets, from those of pages."""
    s.ends = [-1] * len(s.packets)
    length = s.lengths()
    first, before = 0, 0
    for k, (end, granule) in enumerate(s.page_ends):
        s.ends[end - 1] = granule
        if length is not None:
            at = granule
            for i in range(end - 2, first - 1, -1):
                at -= length[i + 1]
                s.ends[i] = at
            start = at - length[first]
            if k and start != before and not (s.opus and before == 0 and start > 0):  # Opus may be cut out of a longer stream
                if start > before or k + 1 < len(s.page_ends):
                    raise OggError(f"stream {s.serial} has a gap or overlap at sample {before}")
                at = before  # the last page may cut its samples short: count forward
                for i in range(first, end - 1):
                    at += length[i]
                    s.ends[i] = min(at, granule)
        first, before = end, granule


def demux(data: bytes) -> dict[int, Stream]:
    """All logical streams by serial number, in order of appearance."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes]] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 4] != CAPTURE or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n_seg = HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n_seg]
        end = at + 27 + n_seg + sum(lacing)
        if version or len(lacing) < n_seg or end > len(data):
            raise OggError(f"page at byte {at} is cut off or of an unknown version")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if (flags & 2 > 0) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        parts = open_.setdefault(serial, [])
        if number != s.pages or s.ended or (flags & 1 > 0) != bool(parts):
            raise OggError(f"page {number} of stream {serial} is out of sequence")
        s.pages += 1
        pos, had = at + 27 + n_seg, len(s.packets)
        for x in lacing:
            parts.append(view[pos : pos + x])
            pos += x
            if x < 255:
                s.packets.append(b"".join(parts))
                parts.clear()
        if (granule >= 0) != (len(s.packets) > had):
            raise OggError(f"page {number} of stream {serial}: its granule position does not fit its packets")
        if granule >= 0:
            s.page_ends.append((len(s.packets), granule))
        s.ended = bool(flags & 4)
        at = end
    if any(open_.values()) or not all(s.ended for s in streams.values()):
        raise OggError("a stream is cut off")
    for s in streams.values():
        _timed(s)
    return streams


def samples_of(s: Stream) -> bytes:
    """A PCM stream's samples, each packet at its time; the last may be cut short."""
    out = bytearray()
    for p, end in zip(s.packets[1:], s.ends[1:], strict=True):
        start = len(out)
        if end < start or end > start + len(p):
            raise OggError(f"stream {s.serial} has a gap or overlap at sample {start}")
        out += p[: end - start]
    return bytes(out)


def read_pcm(data: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """The samples of both channels merged by time, the rate, and the streams."""
    streams = demux(data)
    if len(streams) != 2 or not all(s.pcm for s in streams.values()):
        raise OggError("two PCM channels are expected")
    left, right = (samples_of(s) for s in streams.values())
    if len(left) != len(right):
        raise OggError("the channels differ in length")
    out = bytearray(2 * len(left))
    out[::2], out[1::2] = left, right
    rate = PCM_HEAD.unpack_from(next(iter(streams.values())).packets[0])[4]
    return bytes(out), rate, streams


def features(samples: bytes, rate: int, streams: dict[int, Stream]) -> str:
    """Stream and page counts, length in microseconds from the last granule position, mean level."""
    last = max(g for s in streams.values() for g in s.ends)
    n_packets, n_pages = sum(len(s.packets) for s in streams.values()), sum(s.pages for s in streams.values())
    levels = sum(samples) / max(1, len(samples))
    return f"streams={len(streams)};pages={n_pages};packets={n_packets};us={last * 1_000_000 // rate};level={levels:.3f}"


PACKET_SCHEMA = "serial long, packet int, granule long, seconds double, bytes binary, error string"


def packets(df: DataFrame, media_col: str, key_col: str) -> DataFrame:
    """One row per packet of every Ogg value: key, serial, packet number, granule, end time in seconds by the stream's own rate, bytes; or an error."""
    kind = df.schema[key_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, media in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows, error = [], None
                try:
                    for s in demux(media).values() if media is not None else ():
                        rows += [(s.serial, i, g, s.seconds(g), p, None) for i, (p, g) in enumerate(zip(s.packets, s.ends, strict=True))]
                except OggError as e:
                    error = str(e)
                if error:
                    rows = [(None, None, None, None, None, error)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.string()]
                    arrays = [pa.array([key.as_py()] * len(rows), b.schema.field(0).type)]
                    arrays += [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "serial", "packet", "granule", "seconds", "bytes", "error"])

    return df.select(key_col, media_col).mapInArrow(read, f"key {kind}, {PACKET_SCHEMA}")


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's id columns plus the binary column media, the Ogg form of the padded text; text_col is replaced by it."""
    schema = df.schema
    at = schema.names.index(text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array((mux(pad((x or "").encode())) for x in b.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([media if i == at else c for i, c in enumerate(b.columns)], names=[*b.schema.names[:at], "media", *b.schema.names[at + 1 :]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if i != at else "media binary" for i, f in enumerate(schema))
    return df.mapInArrow(write, kinds)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
OUT_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store and read back in one pass, so that media bytes do not travel between processes."""
    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            media = mux(pad(raw))
            got, rate, streams = read_pcm(media)
            rows.append((key, len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(got, rate, streams)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_digest, OUT_DDL)
