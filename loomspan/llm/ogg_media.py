"""Media columns: bytes stored in and read back from Ogg bitstreams.

The writer multiplexes a payload over ``STREAMS`` logical streams: stream k takes the bytes at k,
k + STREAMS, ... as 8-bit samples, framed in packets of ``PACKET`` samples after one header packet.
Pages hold whole and continued packets by lacing values and carry the granule position (samples
finished so far), a sequence number and the Ogg checksum. Pages of the streams alternate.

The reader trusts nothing: it finds pages by their capture pattern, verifies every checksum and sequence
number, reassembles packets from lacing values over page borders, separates the streams by serial number
and derives times from granule positions; it raises ``OggError`` on what does not fit.

The Ogg checksum (polynomial 0x04C11DB7, most significant bit first, zero start) is the bit mirror of
the usual CRC-32 over bit-mirrored bytes, so the C implementation does the work.

Defined cases: null text counts as empty; an empty text is stored as 64 zero bytes; equal texts give equal
bytes; texts of any length are handled whole, one at a time; rows repeated under one id are stored each; a null id stays null; an empty table gives
an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow

RATE = 8000
STREAMS = 2
PACKET = 4000
PAD = 64
MAGIC = b"\x01u8samp\x00"
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIBBQ")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A bitstream that is not what its pages say."""


def ogg_crc(data: bytes) -> int:
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass(frozen=True)
class Page:
    serial: int
    sequence: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes


def _page_bytes(page: Page) -> bytes:
    head = _HEAD.pack(b"OggS", 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.lacing)) + page.lacing
    crc = ogg_crc(head + page.body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + page.body


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[Page]:
    """Pages of one logical stream. The header packet has a page of its own; no page holds over 255 segments."""
    pages: list[Page] = []

    def flush(lacing: bytearray, body: list[bytes], granule: int, continued: bool, last: bool) -> None:
        flags = (1 if continued else 0) | (2 if not pages else 0) | (4 if last else 0)
        pages.append(Page(serial, len(pages), granule, flags, bytes(lacing), b"".join(body)))

    lacing, body, granule, continued = bytearray(), [], -1, False
    for no, packet in enumerate(packets):
        at, left = 0, len(packet) // 255 + 1  # lacing values of the packet
        while left:
            room = 255 - len(lacing)
            now = min(room, left)
            ends = now == left
            size = len(packet) - at if ends else 255 * now
            lacing += b"\xff" * (now - 1) + bytes([size - 255 * (now - 1)]) if ends else b"\xff" * now
            body.append(packet[at : at + size])
            at, left = at + size, left - now
            if ends:
                granule = granules[no]
            final = no == len(packets) - 1 and ends
            if len(lacing) == 255 or no == 0 and ends or final:
                flush(lacing, body, granule, continued, final)
                lacing, body, granule, continued = bytearray(), [], -1, not ends
    return pages


def write_ogg(payload: bytes, streams: int = STREAMS, packet: int = PACKET) -> bytes:
    """``payload`` as interleaved 8-bit samples of ``streams`` logical streams."""
    tracks = []
    for k in range(streams):
        own = payload[k::streams]
        parts = [own[i : i + packet] for i in range(0, len(own), packet)]
        ends = [min(len(own), i + packet) for i in range(0, len(own), packet)]
        ident = _IDENT.pack(MAGIC, RATE, k, streams, len(payload))
        tracks.append(stream_pages(0x5A000000 + k, [ident, *parts], [0, *ends]))
    out = []
    for at in range(max(map(len, tracks))):
        out.extend(_page_bytes(t[at]) for t in tracks if at < len(t))
    return b"".join(out)


def read_pages(data: bytes) -> list[Page]:
    """All pages, each with its checksum verified."""
    pages, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + _HEAD.size > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(data, at)
        body = at + _HEAD.size + segments
        lacing = data[at + _HEAD.size : body]
        end = body + sum(lacing)
        if version or end > len(data):
            raise OggError(f"broken page at byte {at}")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        pages.append(Page(serial, sequence, granule, flags, lacing, data[body:end]))
        at = end
    return pages


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes]
    #: (packets finished so far, granule position) of each page that finishes one
    marks: list[tuple[int, int]]
    pages: int
    ended: bool


def demultiplex(pages: list[Page]) -> dict[int, LogicalStream]:
    """Logical streams by serial number, packets reassembled over page borders."""
    streams: dict[int, LogicalStream] = {}
    open_parts: dict[int, list[bytes]] = {}
    for page in pages:
        if page.flags & 2:
            if page.serial in streams:
                raise OggError("a serial number begins twice")
            streams[page.serial] = LogicalStream(page.serial, [], [], 0, False)
            open_parts[page.serial] = []
        own = streams.get(page.serial)
        if own is None or own.ended or page.sequence != own.pages:
            raise OggError("page out of place")
        parts = open_parts[page.serial]
        if bool(page.flags & 1) != bool(parts):
            raise OggError("continuation does not fit")
        own.pages += 1
        at = start = 0
        finished = False
        for value in page.lacing:
            at += value
            if value < 255:
                own.packets.append(b"".join([*parts, page.body[start:at]]))
                parts.clear()
                start, finished = at, True
        if start < at:
            parts.append(page.body[start:at])
        if finished:
            own.marks.append((len(own.packets), page.granule))
        elif page.granule != -1:
            raise OggError("granule position on a page that finishes no packet")
        own.ended = bool(page.flags & 4)
    if any(open_parts.values()) or not all(s.ended for s in streams.values()):
        raise OggError("stream without end")
    return streams


def read_ogg(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says about it: streams, pages, packets, seconds, page times."""
    streams = demultiplex(read_pages(data))
    tracks: dict[int, LogicalStream] = {}
    rate, count, total = RATE, 0, 0
    for own in streams.values():
        if not own.packets or len(own.packets[0]) != _IDENT.size:
            raise OggError("a stream without a first packet of its kind")
        magic, rate, k, count, total = _IDENT.unpack(own.packets[0])
        if magic != MAGIC or k in tracks:
            raise OggError("not a stream of samples")
        tracks[k] = own
    if sorted(tracks) != list(range(count)):
        raise OggError("a stream is missing")
    out = np.zeros(total, np.uint8)
    times = []
    for k, own in tracks.items():
        samples = b"".join(own.packets[1:])
        finished = np.cumsum([0, *map(len, own.packets[1:])])
        if any(granule != finished[n - 1] for n, granule in own.marks):
            raise OggError("granule position does not count the samples")
        out[k::count] = np.frombuffer(samples, np.uint8)
        times.append([granule / rate for _, granule in own.marks])
    return out.tobytes(), {
        "streams": count,
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "seconds": max((t[-1] for t in times), default=0.0),
        "page_times": times,
    }


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their number before padding."""
    data = (text or "").encode()
    return data + b"\0" * (max(PAD, -(-len(data) // PAD) * PAD) - len(data)), len(data)


def features(payload: bytes, info: dict) -> str:
    """What one can hear and see of the read-back samples, as one line."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(centred))))
    power = int((centred * centred).sum())
    return (
        f"streams={info['streams']};pages={info['pages']};packets={info['packets']};ms={round(info['seconds'] * 1000)};"
        f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};power={power // len(x)};crossings={crossings};peak={int(x.max())}"
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Stores each text, reads it back and describes what was read; ``keep_bytes`` adds the column ``media``."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep_bytes else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            payload, n = payload_of(text)
            media = write_ogg(payload)
            back, info = read_ogg(media)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), features(back, info))
            rows.append((*row, media) if keep_bytes else row)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()])]
        return pa.record_batch([batch.column(0), *columns], names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, fields)


def op7_ogg(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's Ogg form."""
    return media_columns(docs)
