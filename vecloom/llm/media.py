"""Media columns: MPEG transport streams.

A payload is cut into access units, one PES packet each, and carried in
188-byte packets beside a program association and a program map table. Reading
parses the tables, checks every continuity counter and table checksum, puts the
elementary packets together again and keeps timestamps and random-access points.
"""

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PACKET = 188
PMT_PID, ES_PID = 0x1000, 0x0100
UNIT = 16 * 576  # bytes of an access unit
TICKS = 3600  # 90 kHz clock, 25 units a second
RANDOM_ACCESS_EVERY = 4


def _crc_table():
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([0x47, 0x40 | (pid >> 8), pid & 0xFF, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | (PMT_PID >> 8), PMT_PID & 0xFF])))
# one elementary stream of private data in PES packets, which also carries the clock
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | (ES_PID >> 8), ES_PID & 0xFF, 0xF0, 0, 0x06, 0xE0 | (ES_PID >> 8), ES_PID & 0xFF, 0xF0, 0])))
_HEAD = [bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10 | c]) for c in range(16)]


def _pts(t: int) -> bytes:
    return bytes([0x21 | ((t >> 29) & 0x0E), (t >> 22) & 0xFF, 0x01 | ((t >> 14) & 0xFE), (t >> 7) & 0xFF, 0x01 | ((t << 1) & 0xFE)])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload; unit i has the timestamp i x TICKS."""
    out, cc = [_PAT, _PMT], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        t, rap = (i * TICKS) & 0x1FFFFFFFF, i % RANDOM_ACCESS_EVERY == 0
        unit = b"\x00\x00\x01\xbd\x00\x00\x80\x80\x05" + _pts(t) + payload[at : at + UNIT]
        if len(unit) - 6 <= 0xFFFF:
            unit = unit[:4] + (len(unit) - 6).to_bytes(2, "big") + unit[6:]
        # first packet: adaptation field with the random-access flag and the clock
        field_ = bytes([0x50 if rap else 0x10]) + ((t << 15) | 0x7E00).to_bytes(6, "big")
        take = min(len(unit), PACKET - 5 - len(field_))
        stuff = PACKET - 5 - len(field_) - take
        out.append(bytes([0x47, 0x40 | (ES_PID >> 8), ES_PID & 0xFF, 0x30 | cc, len(field_) + stuff]) + field_ + b"\xff" * stuff + unit[:take])
        cc = (cc + 1) & 15
        while len(unit) - take >= PACKET - 4:
            out.append(_HEAD[cc] + unit[take : take + PACKET - 4])
            cc, take = (cc + 1) & 15, take + PACKET - 4
        if rest := len(unit) - take:
            gap = PACKET - 4 - rest
            pad = b"\x00" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
            out.append(bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc]) + pad + unit[take:])
            cc = (cc + 1) & 15
    return b"".join(out)


@dataclass
class Program:
    """What a transport stream holds: the payload, each unit's timestamp, and (first byte, timestamp) of each random-access unit."""

    payload: bytes = b""
    pid: int = -1
    stream_type: int = -1
    packets: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)


def _table(packet: bytes, table_id: int) -> bytes:
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    if packet[at] != table_id:
        raise ValueError(f"table {packet[at]} where {table_id} belongs")
    end = at + 3 + (((packet[at + 1] & 0x0F) << 8) | packet[at + 2])
    if end > PACKET or section_crc(packet[at:end]) != 0:
        raise ValueError("a table's checksum is wrong")
    return packet[at + 8 : end - 4]


def demux(data: bytes) -> Program:
    """Read a stream back; ValueError for lost sync, a counter out of step, a bad table or packet."""
    if len(data) % PACKET or not data:
        raise ValueError("not a whole number of packets")
    if data[::PACKET].count(0x47) * PACKET != len(data):
        raise ValueError("a packet without its sync byte")
    out, pmt_pid, es_pid, last, pieces, units, size, entry = Program(packets=len(data) // PACKET), -1, -1, {}, [], [], 0, False

    def close():
        nonlocal size
        unit = b"".join(pieces)
        if unit[:3] != b"\x00\x00\x01" or len(unit) < 9 + unit[8]:
            raise ValueError("not an elementary packet")
        if (said := int.from_bytes(unit[4:6], "big")) and said != len(unit) - 6:
            raise ValueError("an elementary packet of the wrong length")
        if unit[7] & 0x80:
            p = unit[9:14]
            out.timestamps.append(((p[0] & 0x0E) << 29) | (p[1] << 22) | ((p[2] & 0xFE) << 14) | (p[3] << 7) | (p[4] >> 1))
            if entry:
                out.random_access.append((size, out.timestamps[-1]))
        units.append(unit[9 + unit[8] :])
        size += len(units[-1])

    for at in range(0, len(data), PACKET):
        b1, flags = data[at + 1], data[at + 3]
        pid = ((b1 & 0x1F) << 8) | data[at + 2]
        if b1 & 0x80:
            raise ValueError("a packet is marked as damaged")
        if flags & 0x10 and pid != 0x1FFF:
            if last.get(pid, flags - 1) + 1 & 15 != flags & 15:
                raise ValueError(f"continuity of pid {pid} broken at packet {at // PACKET}")
            last[pid] = flags & 15
        if pid == es_pid:
            body = at + 4
            if flags & 0x20:
                body += 1 + data[at + 4]
            if b1 & 0x40:
                if pieces:
                    close()
                pieces = []
                entry = bool(flags & 0x20 and data[at + 4] and data[at + 5] & 0x40)
            if flags & 0x10:
                pieces.append(data[body : at + PACKET])
        elif pid == 0 and b1 & 0x40:
            body = _table(data[at : at + PACKET], 0)
            pmt_pid = next((((body[i + 2] & 0x1F) << 8) | body[i + 3] for i in range(0, len(body), 4) if body[i] or body[i + 1]), -1)
        elif pid == pmt_pid and b1 & 0x40:
            body = _table(data[at : at + PACKET], 2)
            i = 4 + (((body[2] & 0x0F) << 8) | body[3])
            out.stream_type, es_pid = body[i], ((body[i + 1] & 0x1F) << 8) | body[i + 2]
    if es_pid < 0:
        raise ValueError("no program")
    if pieces:
        close()
    out.payload, out.pid = b"".join(units), es_pid
    return out


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with 255 to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))


FEATURES = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(text: bytes) -> tuple:
    media = mux(payload_of(text))
    p = demux(media)
    feature = f"mpegts pid={p.pid} type={p.stream_type} packets={p.packets} units={len(p.timestamps)} first={p.timestamps[0]} last={p.timestamps[-1]} random_access={','.join(f'{at}@{t}' for at, t in p.random_access)}"
    return len(text), len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text (null: empty) as a transport stream, read it back and describe it.

    Columns: id_col, those of FEATURES, and with ``with_media`` the stream
    itself; others are not read. ``feature`` has pid, stream type, packets,
    units, the first and last timestamp, and byte@timestamp of every
    random-access point. One pass, a document at a time, so that a worker holds
    a few copies of the longest text; timestamps wrap at 2^33 ticks. Equal texts
    give equal values. Empty table: no rows; repeated rows: each on its own; any
    type of id, null too, is passed through.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    out = f"{id_col} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):  # a few texts at a time
                part = b.slice(at, 512)
                rows, media = [], []
                for t in part.column(1):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    rows.append(features(raw))
                    if with_media:
                        media.append(mux(payload_of(raw)))
                cols = [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), FEATURES, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *([pa.array(media, pa.binary())] if with_media else [])], names=[id_col, *FEATURES.names, *["media"] * with_media])

    return df.select(id_col, df[text].cast("binary").alias("__text")).mapInArrow(run, out)
