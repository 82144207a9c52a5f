"""Ogg pages: write, verify, reassemble, demultiplex, time.

A media column holds one Ogg stream per row with two logical streams: ``PCM8`` (8-bit samples, here the bytes of a
payload) and ``INFO`` (a small record about the payload). Reading checks each page's checksum, puts packets together
from lacing values across pages, keeps the logical streams apart by serial number and gives each packet its time from
the granule positions.

Defined cases: null or empty text is a payload of 64 zero bytes; equal texts give equal bytes; an empty table gives an
empty result; other columns are ignored. A page that is cut off, whose checksum is wrong, or that is missing in its
stream's sequence raises OggError."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import slices

# fixed values of the container format
PAGE = struct.Struct("<4sBBqIIIB")  # capture pattern, version, flags, granule, serial, sequence, checksum, segments
CONTINUED, FIRST, LAST, NO_GRANULE, MOST_SEGMENTS = 1, 2, 4, -1, 255

RATE, PACKET, PCM_SERIAL, INFO_SERIAL = 8000, 4096, 1, 2
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """The format's CRC (polynomial 04C11DB7, most significant bit first, no inversion), through zlib's mirrored one."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule or the one before, page) of one logical stream. packets: with the granule that each ends at."""
    laces: list[tuple[bytes, bool, int]] = []  # a segment, whether it ends its packet, the granule there
    for data, granule in packets:
        cuts = [data[i : i + 255] for i in range(0, len(data), 255)]
        if len(data) % 255 == 0:
            cuts.append(b"")
        laces += [(c, i == len(cuts) - 1, granule) for i, c in enumerate(cuts)]
    # the first packet has a page of its own
    first = next((i for i, x in enumerate(laces) if x[1]), 0) + 1
    groups = [laces[:first]] + [laces[i : i + MOST_SEGMENTS] for i in range(first, len(laces), MOST_SEGMENTS)]
    out, open_packet, reached = [], False, 0
    for k, g in enumerate(groups):
        ends = [x[2] for x in g if x[1]]
        flags = CONTINUED * open_packet | FIRST * (k == 0) | LAST * (k == len(groups) - 1)
        granule = ends[-1] if ends else NO_GRANULE
        lacing, body = bytes(len(x[0]) for x in g), b"".join(x[0] for x in g)
        head = PAGE.pack(b"OggS", 0, flags, granule, serial, k, 0, len(g)) + lacing
        crc = checksum(head + body)
        out.append((reached, head[:22] + crc.to_bytes(4, "little") + head[26:] + body))
        open_packet, reached = not g[-1][1], ends[-1] if ends else reached
    return out


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """One physical stream: all first pages, then pages in order of time."""
    each = [pages(serial, packets) for serial, packets in streams]
    rest = sorted(((granule, k, i, p) for k, x in enumerate(each) for i, (granule, p) in enumerate(x[1:])), key=lambda x: x[:3])
    return b"".join([x[0][1] for x in each] + [p for *_, p in rest])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: granule known for the packet, or None where its page gives a later packet's
    granules: list[int | None] = field(default_factory=list)
    n_pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)

    def times(self, length_of, rate: int) -> list[tuple[float, float]]:
        """(begin, end) of each packet in seconds: a known granule is the end of its packet, others lie before it by
        the packets' own lengths."""
        ends: list[int] = [0] * len(self.packets)
        nxt: int | None = None
        for i in range(len(self.packets) - 1, -1, -1):
            known = self.granules[i]
            ends[i] = known if known is not None else (nxt if nxt is not None else 0)
            nxt = ends[i] - length_of(self.packets[i])
        return [((e - length_of(p)) / rate, e / rate) for e, p in zip(ends, self.packets, strict=True)]


def demux(data: bytes) -> dict[int, Stream]:
    at, out = 0, {}
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise OggError("a page is cut off")
        pattern, version, flags, granule, serial, sequence, crc, n = PAGE.unpack_from(data, at)
        if pattern != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        start, size = at + PAGE.size + n, sum(lacing)
        if len(lacing) < n or start + size > len(data):
            raise OggError("a page is cut off")
        if checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : start + size]))) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in out):
            raise OggError("a logical stream begins twice, or without its first page")
        s = out.setdefault(serial, Stream(serial))
        if sequence != s.n_pages or s.ended or bool(flags & CONTINUED) != bool(s._open):
            raise OggError(f"a page of stream {serial} is missing")
        s.n_pages += 1
        i = 0
        while i < n:
            j = i
            while j < n and lacing[j] == 255:
                j += 1
            length = sum(lacing[i : j + 1])
            s._open.append(data[start : start + length])
            start, i = start + length, j + 1
            if j < n:
                s.packets.append(b"".join(s._open))
                s.granules.append(None)
                s._open = []
        if granule != NO_GRANULE and s.granules:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = start
    if any(s._open or not s.ended for s in out.values()):
        raise OggError("a logical stream doesn't end")
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload as 8-bit samples, with a stream that holds what the payload was padded from."""
    packets = [(b"PCM8" + struct.pack("<IQ", RATE, len(payload)), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    info = [(b"INFO", 0), (struct.pack("<Q", n_bytes), len(payload))]
    return mux([(PCM_SERIAL, packets), (INFO_SERIAL, info)])


def decode(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    streams = demux(media)
    pcm = next((s for s in streams.values() if s.packets[:1] and s.packets[0][:4] == b"PCM8"), None)
    info = next((s for s in streams.values() if s.packets[:1] == [b"INFO"]), None)
    if pcm is None or info is None:
        raise OggError("a logical stream is missing")
    return b"".join(pcm.packets[1:]), struct.unpack("<Q", info.packets[1])[0], streams


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or 64 * (not text))


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id and media, the text's bytes as an Ogg stream."""

    def run(batches):
        for b in slices(batches, "text"):
            raw = [(x or "").encode() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([encode(padded(x), len(x)) for x in raw], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration, packets and pages of the sample stream, mean and RMS of the samples around 128, sign changes."""
    pcm = streams[PCM_SERIAL]
    times = pcm.times(lambda p: 0 if p[:4] == b"PCM8" and len(p) == 16 else len(p), RATE)
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"streams={len(streams)};pages={pcm.n_pages};packets={len(pcm.packets)};seconds={times[-1][1]:.6f};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};turns={turns}"


def features(media: DataFrame) -> DataFrame:
    """Reads a media column back: sizes, digests and features of what it holds."""

    def run(batches):
        for b in slices(batches, "media"):
            rows = []
            for d, cell in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                m = cell.as_buffer().to_pybytes()
                p, n, streams = decode(m)
                rows.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, streams)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    return media.select("doc_id", "media").mapInArrow(run, schema)
