import hashlib
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import mpegts, queries


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def test_query_against_brute_force(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_mpegts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        p = padded(docs[r.doc_id])
        media = mpegts.mux(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.sampled_from([64, 100, 168, 170, 184, 500, 16384]))
def test_round_trip(n, unit):
    payload = os.urandom(n)
    media = mpegts.mux(payload, unit)
    got = mpegts.demux(media)
    assert got.payload == payload and len(media) % 188 == 0
    assert (got.discontinuities, got.damaged, got.units) == (0, 0, -(-n // unit))
    assert got.stamps == [k * 3600 for k in range(got.units)] and got.points == list(range(0, got.units, 8))


def test_stream_is_well_formed():
    media = mpegts.mux(os.urandom(9000), 2000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert all(p[0] == 0x47 for p in packets)
    counters = [p[3] & 15 for p in packets if (p[1] & 0x1F) << 8 | p[2] == mpegts.ES_PID]
    assert counters == [k % 16 for k in range(len(counters))]
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


def test_lost_repeated_and_broken_packets():
    media = mpegts.mux(os.urandom(64_000), 16_000)
    lost = mpegts.demux(media[: 188 * 100] + media[188 * 101 :])
    assert (lost.discontinuities, lost.damaged, lost.units) == (1, 1, 3)
    twice = mpegts.demux(media[: 188 * 100] + media[188 * 99 :])  # permitted
    assert (twice.damaged, twice.discontinuities, twice.units) == (0, 0, 4) and twice.payload == mpegts.demux(media).payload
    for bad in (media[:-1], b"\0" + media[1:], media[:10] + b"\xff" + media[11:], media[188 * 2 :], media[:188]):
        with pytest.raises(ValueError):
            mpegts.demux(bad)


def cut_section(packet, at):
    """A table's packet as two, the section cut after ``at`` bytes."""
    length = 3 + ((packet[6] & 0x0F) << 8 | packet[7])
    whole = packet[5 : 5 + length]
    second = packet[:1] + bytes([packet[1] & 0x1F]) + packet[2:3] + b"\x11" + whole[at:]
    first = packet[:3] + b"\x30" + bytes([188 - 5 - 1 - at]) + b"\x00" + b"\xff" * (188 - 7 - at) + b"\x00" + whole[:at]
    assert len(first) == 188
    return first + second.ljust(188, b"\xff")


def test_tables_over_several_packets_and_several_programs():
    payload = os.urandom(5000)
    media = mpegts.mux(payload, 2000)
    for at in (1, 2, 3, 7, 12, 15):
        split = cut_section(media[:188], at) + cut_section(media[188:376], at)
        assert mpegts.demux(split + media[376:]).payload == payload
        with pytest.raises(ValueError):
            mpegts.demux(split[:188] + split[376:] + media[376:])
    network = mpegts.section_packet(0, 0, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xE0 | mpegts.PMT_PID >> 8, mpegts.PMT_PID & 0xFF]))
    assert mpegts.demux(network + media[188:]).payload == payload
    assert mpegts.demux(media[:188] + media).payload == payload  # a table that is sent again


def test_a_long_unit_that_lost_its_end():
    media = mpegts.mux(os.urandom(300_000), 100_000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    second = next(k for k, p in enumerate(packets) if k > 3 and p[1] & 0x40)
    whole = mpegts.demux(media)
    assert (whole.units, whole.damaged) == (3, 0) and int.from_bytes(packets[second][8:10] if not packets[second][3] & 0x20 else packets[second][10:12], "big") == 0
    lost = mpegts.demux(b"".join(packets[: second - 1] + packets[second:]))
    assert (lost.units, lost.damaged, lost.discontinuities) == (2, 1, 1)


def test_query_keeps_stamps_and_points(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_mpegts(spark, sf).collect():
        units = -(-len(padded(docs[r.doc_id])) // mpegts.UNIT_BYTES)
        assert r.stamps == [k * mpegts.UNIT_TICKS for k in range(units)] and r.points == list(range(0, units, mpegts.UNITS_PER_POINT))


def test_odd_rows(spark, odd, none):
    got = mpegts.media_features(mpegts.store_media(odd)).collect()
    assert sorted(((r.doc_id, r.payload_sha256) for r in got), key=str) == sorted(((r.doc_id, hashlib.sha256(padded(r.text)).hexdigest()) for r in odd.collect()), key=str)
    assert mpegts.media_features(mpegts.store_media(none)).count() == 0
    bad = spark.createDataFrame([(1, 0, b"junk"), (2, 0, None), (3, 0, b"")], "doc_id long, n_bytes long, media binary")
    one, two, three = mpegts.media_features(bad).orderBy("doc_id").collect()
    assert one.error == "not whole packets" and one.payload_sha256 is None and one.media_bytes == 4
    assert two.error is None and two.media_bytes is None and three.error == "no program tables"
