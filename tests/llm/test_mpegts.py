import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm import mpegts, queries
from tests.llm.conftest import by_id


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5760, 9216, 9217, 100_000])
def test_round_trip(n):
    payload = mpegts.padded(bytes(k * 7 % 256 for k in range(n)))
    stream = mpegts.mux_bytes(payload)
    assert len(stream) % mpegts.PACKET == 0 and set(stream[:: mpegts.PACKET]) == {mpegts.SYNC}
    found = mpegts.demux_bytes(stream)
    assert found["payload"] == payload
    assert found["continuity_errors"] == found["crc_errors"] == found["sync_errors"] == 0
    assert (found["program"], found["pmt_pid"], found["es_pid"], found["stream_type"]) == (1, mpegts.PMT_PID, mpegts.ES_PID, mpegts.STREAM_TYPE)
    units = -(-len(payload) // mpegts.AU)
    assert found["pes_packets"] == units == len(found["random_access"])
    assert found["pts"] == [k * mpegts.UNITS_PER_PES * mpegts.TICKS_PER_UNIT for k in range(units)]


def test_table_crc_is_the_public_one():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damage_is_reported():
    stream = bytearray(mpegts.mux_bytes(mpegts.padded(b"a" * 5000)))
    lost = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert mpegts.demux_bytes(lost)["continuity_errors"] == 1
    stream[10] ^= 1
    assert mpegts.demux_bytes(bytes(stream))["crc_errors"] == 1
    assert mpegts.demux_bytes(b"junk")["sync_errors"] == 1
    assert mpegts.demux_bytes(None)["payload"] == b""


def test_odd_rows(spark, odd, empty):
    texts = odd.withColumn("payload", F.encode("text", "UTF-8"))
    rows = by_id(mpegts.demux(mpegts.mux(texts)).withColumn("f", mpegts.feature()))
    assert rows[3]["media"] is None and rows[3]["pes_packets"] == 0
    assert len(rows[2]["payload"]) == 576 and rows[2]["f"] == rows[8]["f"].replace("x", "x")
    assert rows[1]["media"] == rows[4]["media"]
    assert rows[6]["n_bytes"] == 150_003 and len(rows[6]["payload"]) % 576 == 0
    assert mpegts.mux(empty.withColumn("payload", F.encode("text", "UTF-8"))).count() == 0


def test_query(spark, small):
    rows = by_id(queries.op3_mpeg_ts(spark, small))
    docs = by_id(spark.read.parquet(f"{small}/documents.parquet"))
    assert rows.keys() == docs.keys()
    for k, r in rows.items():
        raw = (docs[k]["text"] or "").encode()
        payload = mpegts.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stream = mpegts.mux_bytes(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())


def plain_feature(stream):
    """The same facts, read packet by packet."""
    pids, units, stamps, points, last, broken = {}, [], [], [], None, 0
    for k in range(0, len(stream), 188):
        p = stream[k : k + 188]
        pid, start, control, counter = int.from_bytes(p[1:3], "big") & 0x1FFF, p[1] >> 6 & 1, p[3] >> 4 & 3, p[3] & 15
        body = p[5 + p[4] :] if control & 2 else p[4:]
        if pid != mpegts.ES_PID:
            pids[pid] = body
            continue
        broken += last is not None and counter != (last + 1) % 16
        last = counter
        if control & 2 and p[4] and p[5] & 0x40:
            points.append(k // 188)
        if start:
            units.append(b"")
        units[-1] += body
    for u in units:
        a, b, c, d, e = u[9:14]
        stamps.append(((a >> 1) & 7) * 2**30 + b * 2**22 + (c >> 1) * 2**15 + d * 2**7 + (e >> 1))
    pmt = pids[0][1 + 8 + 2 :][:2]
    program, pmt_pid = int.from_bytes(pids[0][9:11], "big"), int.from_bytes(pmt, "big") & 0x1FFF
    table = pids[pmt_pid][1:]
    kind, es = table[12], int.from_bytes(table[13:15], "big") & 0x1FFF
    ends = lambda x: f"{x[0]}..{x[-1]}"
    return f"program={program};pmt_pid={pmt_pid};es_pid={es};stream_type={kind};packets={len(stream) // 188};pes_packets={len(units)};continuity_errors={broken};crc_errors=0;sync_errors=0;pts={ends(stamps)};rap={len(points)}@{ends(points)}"


def test_feature_of_the_query(spark, small):
    rows, docs = by_id(queries.op3_mpeg_ts(spark, small)), by_id(spark.read.parquet(f"{small}/documents.parquet"))
    for k, r in rows.items():
        assert r["feature"] == plain_feature(mpegts.mux_bytes(mpegts.padded((docs[k]["text"] or "").encode())))


def test_repeated_and_announced_packets():
    stream = mpegts.mux_bytes(mpegts.padded(b"abc" * 3000))
    cut = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    want = mpegts.demux_bytes(stream)["payload"]
    twice = mpegts.demux_bytes(b"".join([*cut[:5], cut[4], *cut[5:]]))
    assert (twice["payload"], twice["continuity_errors"]) == (want, 0)
    thrice = mpegts.demux_bytes(b"".join([*cut[:5], cut[4], cut[4], *cut[5:]]))
    assert thrice["continuity_errors"] == 1
    jump = bytearray(cut[2])  # the first elementary packet has an adaptation field: announce a break there
    jump[5] |= 0x80
    lead = bytearray(cut[3])
    lead[3] = lead[3] & 0xF0 | 9
    assert mpegts.demux_bytes(b"".join([*cut[:2], bytes(lead), bytes(jump), *cut[3:]]))["continuity_errors"] == 0
    assert mpegts.demux_bytes(b"".join([*cut[:2], bytes(lead), *cut[2:]]))["continuity_errors"] == 1


def test_tables_over_several_packets():
    entries = b"".join((0).to_bytes(2, "big") + (0xE000 | 0x10).to_bytes(2, "big") for _ in range(60)) + (7).to_bytes(2, "big") + (0xE000 | mpegts.PMT_PID).to_bytes(2, "big")
    section = mpegts._section(0x00, 1, entries)
    first, rest = section[: 183], section[183:]
    packets = [bytes([0x47, 0x40, 0, 0x10, 0]) + first, (bytes([0x47, 0, 0, 0x11]) + rest).ljust(188, b"\xff")]
    stream = mpegts.mux_bytes(mpegts.padded(b"hello"))
    found = mpegts.demux_bytes(b"".join(packets) + stream[188:])
    assert (found["program"], found["crc_errors"], found["payload"]) == (7, 0, mpegts.padded(b"hello"))
    assert mpegts.demux_bytes(packets[0] + stream[188:])["crc_errors"] == 1


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, b"a"), (1, b"a"), (None, b"a"), (2, None)], "doc_id long, payload binary").withColumns({"media": F.lit("clash"), "pts": F.lit(1)})
    rows = mpegts.demux(mpegts.mux(df)).collect()
    assert sorted((str(r["doc_id"]), r["pes_packets"]) for r in rows) == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
