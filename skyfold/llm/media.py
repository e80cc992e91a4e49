"""Media columns: MPEG transport streams (ISO/IEC 13818-1) made from and read back to payload bytes.

``write_streams`` stores each text's payload as one program: a program association table, a program map table and one
elementary stream of private data, cut into access units with presentation times. The first unit of every ``gop`` is a
random-access point: there the tables are repeated and the clock reference is sent. ``read_streams`` parses the tables,
checks continuity counters, reassembles the elementary packets and keeps the times and random-access points as columns.

Both work row by row inside a task: no shuffle, memory bounded by a batch. Defined results: null and empty texts give
one padding block of spaces; null and repeated doc_ids are rows of their own; an empty table gives no rows; equal texts
give equal streams; further columns of the input are ignored. ``read_streams`` reports damage instead of failing:
``continuity_errors`` counts gaps, ``table_errors`` counts tables whose check value is wrong, and a stream without
readable tables has a null ``payload``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyfold.llm.common import small_batches, text_bytes

PACKET, BLOCK = 188, 192
MAP_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
UNIT = 16 * BLOCK
TICKS = 3600  # of 90 kHz: 25 units a second
GOP = 8

_POLYNOMIAL = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ (_POLYNOMIAL if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()
_known: dict[bytes, int] = {}


def crc32_mpeg(data: bytes) -> int:
    if data in _known:  # streams repeat their few tables
        return _known[data]
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    if len(_known) < 256:
        _known[data] = c
    return c


def _section(table_id: int, body: bytes) -> bytes:
    """A program-specific table of one section, with its check value."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """A whole packet but for its counter, which is the low half of byte 3."""
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0x00, b"\x00\x01" + (0xE000 | MAP_PID).to_bytes(2, "big")))
_PMT = _table_packet(MAP_PID, _section(0x02, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))
_HEAD = [[b"\x47" + (DATA_PID | start).to_bytes(2, "big") + bytes([afc | c]) for c in range(16)] for start, afc in ((0, 0x10), (0, 0x30), (0x4000, 0x10), (0x4000, 0x30))]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _clock(base: int) -> bytes:
    return ((base << 15) | (0x3F << 9)).to_bytes(6, "big")


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counter = table = 0
    for u, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = (u * TICKS) & 0x1FFFFFFFF
        packet = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        entry = u % GOP == 0
        field = b""
        if entry:
            for whole in (_PAT, _PMT):
                out.append(whole[:3] + bytes([0x10 | table]) + whole[4:])
            table = (table + 1) & 15
            field = b"\x50" + _clock(pts)
        i, n, first = 0, len(packet), True
        while i < n:
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = packet[i : i + room]
            if short := room - len(part):
                field = (field or (b"\x00" if short > 1 else b"")) + b"\xff" * (short if field else max(short - 2, 0))
            if field or short:
                out += (_HEAD[2 * first + 1][counter], bytes([len(field)]), field, part)
            else:
                out += (_HEAD[2 * first][counter], part)
            counter = (counter + 1) & 15
            i += room
            field, first = b"", False
    return b"".join(out)


def _tables(rows: np.ndarray, pids: np.ndarray, starts: np.ndarray, pid: int) -> tuple[list[bytes], int]:
    """Bodies of the sections on a pid, and how many have a wrong check value."""
    good, bad = [], 0
    for k in np.flatnonzero(pids == pid):
        raw = rows[k].tobytes()[starts[k] :]
        raw = raw[1 + raw[0] :]
        section = raw[: 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)]
        if len(section) < 12 or crc32_mpeg(section):
            bad += 1
        else:
            good.append(section[8:-4])
    return good, bad


def demux(media: bytes) -> dict:
    """Payload, times and random-access points of a stream's first program."""
    empty = {"payload": None, "program": None, "pid": None, "stream_type": None, "n_packets": len(media) // PACKET, "continuity_errors": 0, "table_errors": 0, "timestamps": [], "random_access": []}
    rows = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    rows = rows[rows[:, 0] == 0x47]
    head = rows[:, 1:6].astype(np.int64)
    pids = (head[:, 0] & 0x1F) << 8 | head[:, 1]
    starts = np.where(head[:, 2] & 0x20, 5 + head[:, 3], 4)
    carries = (head[:, 2] & 0x10) > 0
    sections, bad = _tables(rows, pids, starts, 0)
    empty["table_errors"] = bad
    programs = [(int.from_bytes(b[i : i + 2], "big"), int.from_bytes(b[i + 2 : i + 4], "big") & 0x1FFF) for b in sections[:1] for i in range(0, len(b), 4)]
    programs = [p for p in programs if p[0]]
    if not programs:
        return empty
    maps, worse = _tables(rows, pids, starts, programs[0][1])
    empty["table_errors"] += worse
    if not maps:
        return empty
    body = maps[0]
    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
    kind, pid = body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
    errors = 0
    for p in (0, programs[0][1], pid):
        c = head[(pids == p) & carries, 2] & 0x0F
        errors += int(np.count_nonzero((c[1:] - c[:-1]) % 16 != 1))
    own = (pids == pid) & carries
    rows_own, starts_own, head_own = rows[own], starts[own], head[own]
    sizes = PACKET - starts_own
    joined = rows_own[np.arange(PACKET) >= starts_own[:, None]].tobytes()
    begins = np.flatnonzero(head_own[:, 0] & 0x40)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    parts, times, entries = [], [], []
    for j, k in enumerate(begins):
        end = offsets[begins[j + 1]] if j + 1 < len(begins) else offsets[-1]
        packet = joined[offsets[k] : end]
        if packet[:3] != b"\x00\x00\x01" or len(packet) < 9:
            continue
        length = int.from_bytes(packet[4:6], "big")
        packet = packet[: 6 + length] if length else packet
        pts = None
        if packet[7] & 0x80:
            s = packet[9:14]
            pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
        parts.append(packet[9 + packet[8] :])
        times.append(pts)
        if head_own[k, 2] & 0x20 and head_own[k, 3] and head_own[k, 4] & 0x40:
            entries.append({"pts": pts, "packet": int(np.flatnonzero(own)[k])})
    return empty | {"payload": b"".join(parts), "program": programs[0][0], "pid": pid, "stream_type": kind, "continuity_errors": errors, "timestamps": times, "random_access": entries}


_WRITTEN = "doc_id long, n_bytes long, media binary"
_READ = _WRITTEN + ", payload binary, program int, pid int, stream_type int, n_packets long, continuity_errors long, table_errors long, timestamps array<long>, random_access array<struct<pts: long, packet: long>>"
_POINT = pa.struct([("pts", pa.int64()), ("packet", pa.int64())])
_READ_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("n_packets", pa.int64()), ("continuity_errors", pa.int64()), ("table_errors", pa.int64()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(_POINT))])
#: Bytes of streams in one batch that goes back to Spark.
BATCH_BYTES = 8_000_000


def _runs(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= BATCH_BYTES:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for run in _runs([len(t) for t in texts]):
            part = texts[run]
            yield pa.RecordBatch.from_arrays([batch.column(0)[run.start : run.stop], pa.array([len(t) for t in part], pa.int64()), pa.array([mux(payload_of(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _READ_ARROW.names[3:]
    for batch in batches:
        streams = [x or b"" for x in batch.column(2).to_pylist()]
        for run in _runs([len(s) for s in streams]):
            rows = [demux(s) for s in streams[run]]
            yield pa.RecordBatch.from_arrays([batch.column(i)[run.start : run.stop] for i in range(3)] + [pa.array([r[n] for r in rows], _READ_ARROW.field(n).type) for n in names], schema=_READ_ARROW)


def write_streams(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, and its transport stream."""
    return small_batches(docs).selectExpr(f"cast(`{id_column}` as bigint) doc_id", f"`{text_column}` text").mapInArrow(_write, _WRITTEN)


def read_streams(streams: DataFrame) -> DataFrame:
    """The streams with what reading them gives: payload, tables, errors, timestamps and random-access points."""
    return streams.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ)


def digest(read: DataFrame) -> DataFrame:
    """The contract's columns."""
    feature = "format_string('program=%d pid=%d type=%d packets=%d units=%d last_pts=%d entries=%d errors=%d', program, pid, stream_type, n_packets, size(timestamps), array_max(timestamps), size(random_access), continuity_errors + table_errors)"
    return read.selectExpr("doc_id", "n_bytes", "cast(octet_length(payload) as bigint) payload_bytes", "sha2(payload, 256) payload_sha256", "crc32(substring(payload, -16, 16)) tail_crc32", "cast(octet_length(media) as bigint) media_bytes", "sha2(media, 256) media_sha256", f"{feature} feature")
