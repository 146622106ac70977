"""MPEG transport streams as a media column.

A payload travels in packets of 188 bytes: a program association table and a program map
table, then one elementary stream of access units. Each access unit is a PES packet with
a presentation time stamp; its first transport packet may be a random-access point. Stuffing
in the adaptation field of a unit's last packet keeps the payload exact. Reading parses the
tables, checks continuity counters, reassembles PES packets and keeps time stamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, slices, written

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, STREAM_TYPE = 0x0100, 0x0101, 0x06
#: Bytes of an access unit, units from one random-access point to the next, clock ticks of a unit (90 kHz, 25 a second).
UNIT_BYTES, UNITS_PER_POINT, UNIT_TICKS = 16384, 8, 3600
#: A payload is padded with zeros to a positive multiple of this.
ALIGN = 64
PES_HEAD = 14


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, not reflected, starts at all ones."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, table: int, body: bytes, extension: int = 1) -> bytes:
    length = len(body) + 9
    section = bytes([table, 0xB0 | length >> 8, length & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


#: One program with one stream of private data.
PAT = section_packet(0, 0, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
PMT = section_packet(PMT_PID, 2, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))


def stamp(ticks: int) -> bytes:
    """A presentation time stamp in its five bytes."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 1 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 1 | ticks << 1 & 0xFE])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """The stream that carries ``payload``; an empty payload has tables only."""
    out, counter = [PAT, PMT], 0
    for k, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        point = k % UNITS_PER_POINT == 0
        length = len(data) + PES_HEAD - 6
        pes = b"\x00\x00\x01\xbd" + (length if length < 1 << 16 else 0).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(k * UNIT_TICKS % (1 << 33)) + data
        first = 2 if point else 0  # bytes of adaptation field in the first packet
        n = -(-(len(pes) + first) // 184)
        spare = n * 184 - len(pes) - first
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 1] |= 0x40
        counter = counter + n & 15
        body = np.frombuffer(pes, np.uint8)
        lead = 184 - first if n > 1 else len(pes)
        if first or n == 1 and spare:
            fill = first + (spare if n == 1 else 0)
            adapt(packets[0], fill, point)
        packets[0, PACKET - lead :] = body[:lead]
        if n > 1:
            tail = 184 - spare
            middle = body[lead : len(body) - tail]
            packets[1 : n - 1, 4:] = middle.reshape(n - 2, 184)
            if spare:
                adapt(packets[n - 1], spare, False)
            packets[n - 1, PACKET - tail :] = body[len(body) - tail :]
        out.append(packets.tobytes())
    return b"".join(out)


def adapt(packet: np.ndarray, n: int, point: bool) -> None:
    """Puts an adaptation field of ``n`` bytes, its length byte included, into a packet."""
    packet[3] |= 0x20
    packet[4] = n - 1
    if n > 1:
        packet[5] = 0x40 if point else 0
        packet[6 : 4 + n] = 0xFF


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    units: int = 0
    stamps: list[int] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    discontinuities: int = 0
    damaged: int = 0

    @property
    def feature(self) -> str:
        span = f"{self.stamps[0]}-{self.stamps[-1]}" if self.stamps else "-"
        return f"packets={self.packets};units={self.units};points={len(self.points)};pts={span};gaps={self.discontinuities};damaged={self.damaged};crc={zlib.crc32(self.payload):08x}"


def payload_of(packet: bytes) -> bytes:
    return packet[4 + (1 + packet[4] if packet[3] & 0x20 else 0) :] if packet[3] & 0x10 else b""


def section(packets: np.ndarray, table: int) -> bytes:
    """The body of the first whole section of one PID, over as many packets as it takes, after its check value is verified.

    The pointer of the packet where a section starts tells how many bytes of an earlier one
    come first. Packets that repeat the one before are passed over.
    """
    raws = [p.tobytes() for p in packets]
    raws = [r for k, r in enumerate(raws) if not k or r != raws[k - 1]]
    start = next(k for k, r in enumerate(raws) if r[1] & 0x40)
    first = payload_of(raws[start])
    whole = first[1 + first[0] :]
    counter = raws[start][3] & 15
    for r in raws[start + 1 :]:
        length = (whole[1] & 0x0F) << 8 | whole[2] if len(whole) > 2 else 1 << 12
        if len(whole) >= 3 + length:
            break
        counter = counter + 1 & 15
        if r[3] & 15 != counter:
            break  # a lost packet; what is missing fails the check
        rest = payload_of(r)
        whole += rest[1 : 1 + rest[0]] if r[1] & 0x40 else rest
    if len(whole) < 3:
        raise ValueError("damaged table")
    whole = whole[: 3 + ((whole[1] & 0x0F) << 8 | whole[2])]
    if whole[0] != table or len(whole) < 12 or section_crc(whole):
        raise ValueError("damaged table")
    return whole[8:-4]


def demux(media: bytes) -> Stream:
    """Parses the first program's first stream. Units with a lost packet, or of the wrong length, are left out and counted.

    A packet may be sent twice in a row; the second one is passed over. A unit that tells
    no length, as those of 64 KB and more, has lost its end if the counter jumps where the
    next one begins. Tables may take several packets. A stream whose packets aren't
    aligned, or whose tables are missing or damaged, raises ``ValueError``.
    """
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    try:
        programs = section(packets[pids == 0], 0)
        entries = [programs[k : k + 4] for k in range(0, len(programs) - 3, 4)]
        own_map = next(e for e in entries if e[0] << 8 | e[1])  # program 0 is the network's own
        program = section(packets[pids == ((own_map[2] & 0x1F) << 8 | own_map[3])], 2)
    except StopIteration:
        raise ValueError("no program tables") from None
    at = 4 + ((program[2] & 0x0F) << 8 | program[3])
    if len(program) < at + 5:
        return Stream(packets=len(packets))
    es_pid = (program[at + 1] & 0x1F) << 8 | program[at + 2]
    own = packets[(pids == es_pid) & (packets[:, 3] & 0x10 != 0)]
    again = np.zeros(len(own), bool)
    again[1:] = ((own[1:, 3] ^ own[:-1, 3]) & 15 == 0) & (own[1:, 4:] == own[:-1, 4:]).all(axis=1)
    own = own[~again]
    out = Stream(packets=len(packets))
    if not len(own):
        return out
    adapted = own[:, 3] & 0x20 != 0
    offset = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    point = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)
    gap = np.zeros(len(own), bool)
    gap[1:] = np.diff(own[:, 3] & 15) & 15 != 1
    out.discontinuities = int(gap.sum())
    first = np.flatnonzero(own[:, 1] & 0x40)
    if not len(first):
        out.damaged = 1
        return out
    out.damaged += int(first[0] > 0)  # packets of a unit whose beginning is lost
    body = own[np.arange(PACKET) >= offset[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - offset)]).tolist()
    pieces = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
        pes = body[ends[a] : ends[z]]
        length = int.from_bytes(pes[4:6], "big")
        open_end = not length and z < len(own) and gap[z]
        if pes[:3] != b"\x00\x00\x01" or gap[a + 1 : z].any() or open_end or length and length != len(pes) - 6 or len(pes) < 9:
            out.damaged += 1
            continue
        if pes[7] & 0x80:
            t = pes[9:14]
            out.stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        if point[a]:
            out.points.append(out.units)
        out.units += 1
        pieces.append(pes[9 + pes[8] :])
    out.payload = b"".join(pieces)
    return out


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The written table ``(doc_id, n_bytes, media)``: each text as a transport stream.

    The payload is the text's UTF-8 and zeros up to a positive multiple of 64 bytes; null
    is empty. Equal texts have equal streams. Null ids and repeated rows are kept; an empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 1, 4 << 20):
                raw = [(t or "").encode() for t in some.column(1).to_pylist()]
                media = [mux(r + bytes(-len(r) % ALIGN or ALIGN * (not r)), unit_bytes) for r in raw]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return written(map_batches(docs.select(doc_id, text), run, f"doc_id {kind}, n_bytes long, media binary"), "media", compression="zstd")


def media_features(stored: DataFrame) -> DataFrame:
    """What a parse of the stored bytes yields, ``n_bytes`` passed on.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64
    bytes), media_bytes, media_sha256, feature, stamps (90 kHz), points (units that can be
    entered at), error. A row whose stream can't be parsed has the reason in ``error`` and
    null in what a payload is needed for; null media have null in all of these.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, points array<int>, error string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]
    names = [x.split()[0] for x in columns.split(", ")]

    def read(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 9
        own = len(media), hashlib.sha256(media).hexdigest()
        try:
            s = demux(media)
        except ValueError as e:
            return None, None, None, *own, None, None, None, str(e)
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), *own, s.feature, s.stamps, s.points, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*map(read, (x.as_py() for x in b.column(2))), strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=names)

    return map_batches(stored.select("doc_id", "n_bytes", "media"), run, columns)
