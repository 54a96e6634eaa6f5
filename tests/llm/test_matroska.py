import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_round_trip(payload):
    data = m.write_pcm(payload)
    packets, cues, codecs = m.read(data)
    assert m.samples(data) == payload and codecs == {1: "A_PCM/INT/LIT"}
    assert all(p.keyframe for p in packets) and [p.timestamp for p in packets] == sorted(p.timestamp for p in packets)
    assert {c for _, _, c in cues} == {p.cluster for p in packets}


def test_clusters_and_cues_of_long_payloads():
    payload = bytes(range(256)) * 1100
    data = m.write_pcm(payload)
    packets, cues, _ = m.read(data)
    assert len(cues) == 5 and m.samples(data) == payload
    for time, track, at in cues:
        assert data[at : at + 4] == m.element_id(m.CLUSTER) and track == 1
        assert any(p.cluster == at and p.timestamp == time for p in packets)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=12), st.integers(-32768, 32767), st.integers(1, 200), st.sampled_from([m.XIPH, m.EBML_LACE]))
def test_laces(frames, time, track, kind):
    body = m.block(track, time, frames, kind)
    got_track, got_time, flags, spans = m.frames_of(body, 0, len(body))
    assert (got_track, got_time, flags >> 1 & 3) == (track, time, kind)
    assert [body[a : a + n] for a, n in spans] == frames


def test_fixed_lace_block_groups_and_unknown_sizes():
    frames = [b"abcd", b"efgh", b"ijkl"]
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, 5, frames, m.FIXED)) + m.element(m.REFERENCE, b"\x01"))
    simple = m.element(m.SIMPLE_BLOCK, m.block(1, -1, [b"zz"], m.NONE, keyframe=False))
    unknown = m.element_id(m.CLUSTER) + b"\x01" + b"\xff" * 7
    body = unknown + m.unsigned(m.TIMESTAMP, 100) + group + unknown + m.unsigned(m.TIMESTAMP, 300) + simple
    data = m.element(m.EBML, b"") + m.element_id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + body
    packets, _, _ = m.read(data)
    assert [(p.track, p.timestamp, p.keyframe, data[p.start : p.start + p.length]) for p in packets] == [
        (2, 105, False, b"abcd"), (2, 105, False, b"efgh"), (2, 105, False, b"ijkl"), (1, 299, False, b"zz"),
    ]


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**28])
def test_variable_length_integers(n):
    value, _, after = m.read_vint(m.vint(n), 0)
    assert value == n and after == len(m.vint(n))
    assert m.read_vint(b"\xff", 0)[0] == -1


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 50, "x" * 64, "long " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "q")], "doc_id long, text string, media string")
    got = {str(r.doc_id): r for r in m.media_digests(m.to_media(docs)).collect()}
    assert len(got) == 8
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[str(i)]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got["2"].media_sha256 == got["6"].media_sha256 and got["2"].feature == got["6"].feature
    assert m.media_digests(m.to_media(docs.limit(0))).count() == 0


def test_packet_table(spark):
    bad = m.write_pcm(b"x" * 2000)[:-900]
    rows = [(1, m.write_pcm(b"y" * 1000)), (2, b"\x00\x01junk"), (3, None), (4, bad)]
    got = m.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1000
    assert [r.error is not None for r in got if r.doc_id == 2] == [True]
    assert not [r for r in got if r.doc_id == 3]
    assert [(r.error is not None, r.start) for r in got if r.doc_id == 4] == [(True, None)]


def test_a_file_cut_anywhere_is_an_error():
    data = m.write_pcm(bytes(range(200)) * 15)
    for cut in range(60, len(data), 37):
        with pytest.raises((ValueError, IndexError, struct.error)):
            m.read(data[:cut])


def test_times_and_durations():
    """Units of half a millisecond; a lace by its track's default, one by its block's duration, a frame with neither."""
    info = m.element(m.INFO, m.unsigned(m.TIMESTAMP_SCALE, 500_000))
    entry = lambda n, *more: m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, n) + b"".join(more))
    tracks = m.element(m.TRACKS, entry(1, m.unsigned(m.DEFAULT_DURATION, 20_000_000)) + entry(2))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, 4, [b"ab", b"cd", b"ef"], m.FIXED)) + m.unsigned(m.BLOCK_DURATION, 12))
    simple = m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"x", b"yy"], m.XIPH)) + m.element(m.SIMPLE_BLOCK, m.block(2, -1, [b"z"], m.NONE))
    data = m.element(m.EBML, b"") + m.element(m.SEGMENT, info + tracks + m.element(m.CLUSTER, m.unsigned(m.TIMESTAMP, 100) + simple + group))
    assert [(p.track, p.timestamp, p.time_ns, p.duration_ns) for p in m.read(data)[0]] == [
        (1, 100, 50_000_000, 20_000_000), (1, 100, 70_000_000, 20_000_000), (2, 99, 49_500_000, None),
        (2, 104, 52_000_000, 2_000_000), (2, 104, 54_000_000, 2_000_000), (2, 104, 56_000_000, 2_000_000),
    ]


def test_seek_heads_voids_and_checksums():
    summed = lambda body: m.element(m.CRC_32, zlib.crc32(body).to_bytes(4, "little")) + body
    void = m.element(m.VOID, b"\x00\xff junk \x80")
    tracks = m.element(m.TRACKS, summed(void + m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, 3) + m.element(m.CODEC_ID, b"V_X"))))
    inner = m.unsigned(m.TIMESTAMP, 9) + void + m.element(m.SIMPLE_BLOCK, m.block(3, 1, [b"frame"], m.NONE))
    cues = m.element(m.CUES, void + m.element(m.CUE_POINT, m.unsigned(m.CUE_TIME, 9) + m.element(m.CUE_POSITIONS, m.unsigned(m.CUE_TRACK, 3) + m.unsigned(m.CUE_CLUSTER, 7))))
    body = m.element(m.SEEK_HEAD, b"\x4d\xbb\x80") + void + tracks + m.element(m.CLUSTER, summed(inner)) + cues
    data = m.element(m.EBML, b"") + m.element(m.SEGMENT, body)
    packets, found, codecs = m.read(data)
    assert [(p.track, p.timestamp, data[p.start : p.start + p.length]) for p in packets] == [(3, 10, b"frame")]
    assert codecs == {3: "V_X"} and [c[:2] for c in found] == [(9, 3)]
    with pytest.raises(ValueError, match="checksum"):
        m.read(data.replace(b"frame", b"frane"))
