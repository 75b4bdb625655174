"""MPEG transport streams as media columns (ISO/IEC 13818-1 framing).

mux() stores a binary payload losslessly: a program association table, a program map table, then the payload cut into
access units, each one PES packet of a private stream with a presentation time stamp, spread over 188-byte packets.
Every unit starts a packet whose adaptation field flags a random-access point and carries a clock reference.
demux() reads such a stream back: it checks sync bytes and the tables' CRC, follows PAT to PMT to the elementary
stream, checks continuity counters, reassembles PES packets, and reports time stamps and random-access points.  Tables
may be spread over several packets; a packet that is sent twice, and a break that is announced, are no errors.

Nulls: a null payload gives a null stream; a null or empty stream gives an empty payload with zero counts.  A damaged
stream doesn't stop a job: its row says so in `crc_errors`, `continuity_errors` and `sync_errors`.  Payloads are stored
whole, however long; equal ones give equal streams.  Rows that repeat are rows of their own; a null id stays null.  Other
columns, whatever their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import blocks

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD  # private data in PES packets, private_stream_1
#: Payload unit of the contract, units in a PES packet, and 90 kHz ticks that one payload unit lasts.
UNIT, UNITS_PER_PES, TICKS_PER_UNIT = 576, 16, 1080
AU = UNIT * UNITS_PER_PES
PES_HEADER = 14
MEDIA_SCHEMA = "payload binary, packets bigint, pes_packets bigint, pts array<bigint>, random_access array<bigint>, program int, pmt_pid int, es_pid int, stream_type int, continuity_errors bigint, crc_errors bigint, sync_errors bigint"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = ((table << np.uint64(1)) ^ np.where(table & np.uint64(0x80000000), np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    return table


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: most significant bit first, all ones at the start, not inverted."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | (ticks >> 30 & 7) << 1 | 1, ticks >> 22 & 255, (ticks >> 15 & 127) << 1 | 1, ticks >> 7 & 255, (ticks & 127) << 1 | 1])


def mux_bytes(payload: bytes) -> bytes:
    """A whole transport stream of one payload."""
    out, counter = [PAT, PMT], 0
    for start in range(0, len(payload), AU):
        unit = payload[start : start + AU]
        ticks = start // UNIT * TICKS_PER_UNIT & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + unit
        # The first packet: random-access flag, PCR flag, clock reference (33 bits base, 6 reserved, 9 extension).
        room = BODY - 8
        first, rest = pes[:room], pes[room:]
        stuffing = room - len(first)
        clock = (ticks << 15 | 0x3F << 9).to_bytes(6, "big")
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter, 7 + stuffing, 0x50]) + clock + b"\xff" * stuffing + first)
        counter = counter + 1 & 15
        full, tail = divmod(len(rest), BODY)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (np.arange(full) + counter & 15)
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if tail:
            spare = BODY - tail
            field = bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter]) + field + rest[full * BODY :])
            counter = counter + 1 & 15
    return b"".join(out)


def _sections(packets: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """The sections of one PID's packets (whether one starts there, body), each possibly spread over several packets."""
    buffer: bytes | None = None
    for starts, body in packets:
        if starts:
            pointer = body[0] if body else 0
            tail, head = body[1 : 1 + pointer], body[1 + pointer :]
            if buffer:
                done, cut_off = _whole(buffer + tail)
                yield from [*done, cut_off] if cut_off else done
            buffer = head
        elif buffer is not None:
            buffer += body
        if buffer is not None:
            done, buffer = _whole(buffer)
            yield from done
    if buffer:
        yield buffer  # one that never ended


def _whole(buffer: bytes) -> tuple[list[bytes], bytes]:
    """The complete sections that buffer starts with, and what is left; stuffing is dropped."""
    out = []
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
        if len(buffer) < size:
            return out, buffer
        out.append(buffer[:size])
        buffer = buffer[size:]
    return out, b"" if buffer[:1] in (b"", b"\xff") else buffer


def demux_bytes(stream: bytes | None) -> dict:
    """What a reader learns from a stream; see MEDIA_SCHEMA."""
    out = {"payload": b"", "packets": 0, "pes_packets": 0, "pts": [], "random_access": [], "program": None, "pmt_pid": None, "es_pid": None, "stream_type": None, "continuity_errors": 0, "crc_errors": 0, "sync_errors": 0}
    if not stream:
        return out
    n, extra = divmod(len(stream), PACKET)
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    good = packets[:, 0] == SYNC
    out["packets"], out["sync_errors"] = n, int(n - good.sum()) + (extra > 0)
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts, control = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3
    counters = packets[:, 3] & 15
    fields = np.where(control & 2, packets[:, 4].astype(np.int32) + 1, 0)
    begin = np.where(control & 1, np.minimum(4 + fields, PACKET), PACKET)

    def table(pid: int, want: int) -> bytes | None:
        found = None
        rows = np.flatnonzero(good & (pids == pid) & (control & 1 > 0))
        for section in _sections([(bool(starts[k]), packets[k, begin[k] :].tobytes()) for k in rows]):
            if len(section) < 12 or crc32_mpeg(section) != 0:
                out["crc_errors"] += 1
            elif section[0] == want and found is None:
                found = section[8:-4]
        return found

    pat = table(PAT_PID, 0x00)
    for at in range(0, len(pat or b"") - 3, 4):
        number, pid = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
        if number and out["program"] is None:
            out["program"], out["pmt_pid"] = number, pid
    pmt = table(out["pmt_pid"], 0x02) if out["pmt_pid"] is not None else None
    if pmt and len(pmt) >= 4:
        at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
        if at + 5 <= len(pmt):
            out["stream_type"], out["es_pid"] = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    if out["es_pid"] is None:
        return out
    own = np.flatnonzero(good & (pids == out["es_pid"]))
    carrying = own[control[own] & 1 > 0]
    # A packet may be sent twice in a row, clock reference apart; the second says nothing new.
    same = (np.diff(counters[carrying].astype(np.int32)) == 0) & (starts[carrying][1:] == starts[carrying][:-1])
    for k in np.flatnonzero(same):
        a, b = carrying[k], carrying[k + 1]
        same[k] = bytes(packets[a, begin[a] :]) == bytes(packets[b, begin[b] :])
    twice = np.concatenate([[False], same & ~np.concatenate([[False], same[:-1]])]) if len(carrying) else np.zeros(0, bool)
    carrying = carrying[~twice]
    steps = np.diff(counters[carrying].astype(np.int32)) & 15
    # A break that its packet announces is none.
    announced = (control[carrying] & 2 > 0) & (packets[carrying, 4] > 0) & (packets[carrying, 5] & 0x80 > 0)
    out["continuity_errors"] = int(((steps != 1) & ~announced[1:]).sum())
    heads = np.flatnonzero(starts[carrying])
    flagged = (control[carrying] & 2 > 0) & (packets[carrying, 4] > 0) & (packets[carrying, 5] & 0x40 > 0)
    out["random_access"] = [int(x) for x in carrying[flagged]]
    inner = np.arange(PACKET)
    parts = []
    for k, head in enumerate(heads):
        rows = carrying[head : heads[k + 1] if k + 1 < len(heads) else len(carrying)]
        pes = packets[rows][inner >= begin[rows][:, None]].tobytes()
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            out["sync_errors"] += 1
            continue
        length = int.from_bytes(pes[4:6], "big")
        parts.append(pes[9 + pes[8] : 6 + length if length else None])
        out["pes_packets"] += 1
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            out["pts"].append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
    out["payload"] = b"".join(parts)
    return out


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 appended up to a positive multiple of unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\xff")


def mux(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """doc_id, payload_in_bytes, media: the transport stream of each row's binary payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            raw = block.column(1).to_pylist()
            media = [None if x is None else mux_bytes(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([None if x is None else len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def demux(df: DataFrame) -> DataFrame:
    """Adds what demux_bytes() reads from `media` to doc_id, n_bytes, media."""
    schema = f"doc_id bigint, n_bytes bigint, media binary, {MEDIA_SCHEMA}"
    kinds = {"payload": pa.binary(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())} | dict.fromkeys(("program", "pmt_pid", "es_pid", "stream_type"), pa.int32())
    names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text=2):
            read = [demux_bytes(x) for x in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, *(pa.array([r[c] for r in read], kinds.get(c, pa.int64())) for c in names)], names=["doc_id", "n_bytes", "media", *names])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def feature() -> Column:
    """A stream's tables, counts, time stamps and random-access points as one string."""
    part = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("none")))
    ends = lambda c: F.concat(F.coalesce(F.try_element_at(c, F.lit(1)).cast("string"), F.lit("none")), F.lit(".."), F.coalesce(F.try_element_at(c, F.lit(-1)).cast("string"), F.lit("none")))
    single = ("program", "pmt_pid", "es_pid", "stream_type", "packets", "pes_packets", "continuity_errors", "crc_errors", "sync_errors")
    return F.concat_ws(";", *(part(c, F.col(c)) for c in single), F.concat(F.lit("pts="), ends(F.col("pts"))), F.concat(F.lit("rap="), F.size("random_access"), F.lit("@"), ends(F.col("random_access"))))
