"""Media columns: Matroska, written and parsed as EBML.

Parses variable-length elements (also of unknown size), clusters, simple blocks and block groups,
all three lacings and cues into a packet table. The writer makes what the parser's tests and the
query need: one PCM track in clusters of laced blocks with cues.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CRC_32, VOID, SEEK_HEAD = 0xBF, 0xEC, 0x114D9B74
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, 0x1043A770, 0x1941A469, 0x1254C367}
#: Laces by the two bits of a block's flags.
NONE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
RATE, FRAME, LACE, CLUSTER_BYTES = 8000, 512, 8, 65536


class Packet(NamedTuple):
    track: int
    timestamp: int  # in units of the timestamp scale; a laced frame has its block's
    keyframe: bool
    cluster: int  # offset of the cluster's element
    start: int  # byte range of the frame in the file
    length: int
    time_ns: int  # of the frame itself: laced frames follow each other where their duration is known
    duration_ns: int | None  # from the block, else the track's default


# --- writing -----------------------------------------------------------------


def element_id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(value: int, length: int | None = None) -> bytes:
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(number: int, body: bytes) -> bytes:
    return element_id(number) + vint(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's body after its flags."""
    if kind == NONE:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACE:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: int, keyframe: bool = True) -> bytes:
    return vint(track) + struct.pack(">hB", relative, (0x80 if keyframe else 0) | kind << 1) + lace(frames, kind)


def write_pcm(payload: bytes, rate: int = RATE) -> bytes:
    """A file whose one track holds payload as 8-bit PCM samples."""
    header = element(
        EBML,
        unsigned(EBML_VERSION, 1) + unsigned(EBML_READ, 1) + unsigned(EBML_ID_LENGTH, 4) + unsigned(EBML_SIZE_LENGTH, 8)
        + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ, 2),
    )
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / rate)) + element(MUXING_APP, b"weft") + element(WRITING_APP, b"weft"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body, cues = [info, element(TRACKS, element(TRACK_ENTRY, entry))], []
    at = sum(map(len, body))
    for begin in range(0, len(payload), CLUSTER_BYTES):
        time = begin * 1000 // rate
        parts = [unsigned(TIMESTAMP, time)]
        end = min(begin + CLUSTER_BYTES, len(payload))
        for low in range(begin, end, FRAME * LACE):
            high = min(low + FRAME * LACE, end)
            frames = [payload[k : min(k + FRAME, high)] for k in range(low, high, FRAME)]
            even = len(frames[-1]) == FRAME
            kind = NONE if len(frames) == 1 else FIXED if even else EBML_LACE if len(frames) % 2 else XIPH
            parts.append(element(SIMPLE_BLOCK, block(1, low * 1000 // rate - time, frames, kind)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


# --- parsing -----------------------------------------------------------------


def read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """(value, the same with the length marker, offset after); a size of all ones is unknown: -1."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError("no variable-length integer here")
    whole = int.from_bytes(data[at : at + length], "big")
    value = whole ^ 1 << 7 * length
    return (-1 if value == (1 << 7 * length) - 1 else value), whole, at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, offset of the element, start and end of its body) of the elements between two offsets.

    An element that runs past the end is an error: a file cut short isn't read as a whole one. Void
    elements are passed over; a CRC-32, which comes first, is held against the rest.
    """
    first = True
    while at < end:
        begin = at
        _, number, at = read_vint(data, at)
        size, _, at = read_vint(data, at)
        after = at + size if size >= 0 else unknown_end(data, at, end, number)
        if after > end:
            raise ValueError(f"element {number:X} at {begin} runs past its parent's end")
        if number == CRC_32 and first:
            if int.from_bytes(data[at:after], "little") != zlib.crc32(data[after:end]):
                raise ValueError(f"checksum at {begin} does not match")
        elif number != VOID:
            yield number, begin, at, after
        at, first = after, False


def unknown_end(data: bytes, at: int, end: int, number: int) -> int:
    """Where an element of unknown size ends: before the next element of its own level or above."""
    stop = {EBML, SEGMENT} if number == SEGMENT else TOP
    while at < end:
        _, inner, after = read_vint(data, at)
        if inner in stop:
            return at
        size, _, after = read_vint(data, after)
        at = after + size if size >= 0 else unknown_end(data, after, end, inner)
    return end


def number_in(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frames_of(data: bytes, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, [(start, length)]) of a block's body."""
    track, _, at = read_vint(data, start)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NONE:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, _, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            whole = int.from_bytes(data[at : at + length], "big") ^ 1 << 7 * length
            size += whole - ((1 << 7 * length - 1) - 1)
            sizes.append(size)
            at += length
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run over their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, relative, flags, out


def read(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], dict[int, str]]:
    """Packets in file order, cues as (time, track, offset of the cluster), codec by track."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    codecs: dict[int, str] = {}
    scale, lasting = 1_000_000, dict[int, int]()  # a segment's own, where it says nothing
    for number, _, start, end in elements(data, 0, len(data)):
        if number != SEGMENT:
            continue
        for kind, begin, low, high in elements(data, start, end):
            if kind == INFO:
                scale = next((number_in(data, a, b) for k, _, a, b in elements(data, low, high) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for _, _, a, b in (x for x in elements(data, low, high) if x[0] == TRACK_ENTRY):
                    entry = {k: (x, y) for k, _, x, y in elements(data, a, b)}
                    if TRACK_NUMBER in entry:
                        track = number_in(data, *entry[TRACK_NUMBER])
                        codecs[track] = data[slice(*entry.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
                        if DEFAULT_DURATION in entry:
                            lasting[track] = number_in(data, *entry[DEFAULT_DURATION])
            elif kind == CLUSTER:
                packets += cluster(data, begin, low, high, scale, lasting)
            elif kind == CUES:
                for _, _, a, b in (x for x in elements(data, low, high) if x[0] == CUE_POINT):
                    point = [(k, x, y) for k, _, x, y in elements(data, a, b)]
                    at = next((number_in(data, x, y) for k, x, y in point if k == CUE_TIME), 0)
                    for k, x, y in point:
                        if k == CUE_POSITIONS:
                            p = {m: number_in(data, c, d) for m, _, c, d in elements(data, x, y)}
                            cues.append((at, p.get(CUE_TRACK, 0), start + p.get(CUE_CLUSTER, 0)))
    return packets, cues, codecs


def cluster(data: bytes, begin: int, low: int, high: int, scale: int, lasting: dict[int, int]) -> Iterator[Packet]:
    """A cluster's packets. scale: nanoseconds of a timestamp's unit; lasting: of a frame, by track."""
    time = 0
    for kind, _, a, b in elements(data, low, high):
        key = duration = None
        if kind == TIMESTAMP:
            time = number_in(data, a, b)
        if kind == BLOCK_GROUP:
            group = {k: (x, y) for k, _, x, y in elements(data, a, b)}
            if BLOCK not in group:
                continue
            key = REFERENCE not in group
            if BLOCK_DURATION in group:
                duration = number_in(data, *group[BLOCK_DURATION]) * scale
            a, b = group[BLOCK]
        elif kind != SIMPLE_BLOCK:
            continue
        track, relative, flags, frames = frames_of(data, a, b)
        key = bool(flags & 0x80) if key is None else key
        each = lasting.get(track) if duration is None else duration // len(frames)
        for k, (s, n) in enumerate(frames):
            yield Packet(track, time + relative, key, begin, s, n, (time + relative) * scale + k * (each or 0), each)


def samples(data: bytes, track: int = 1) -> bytes:
    """A track's frames in order, found by the packet table."""
    return b"".join([data[p.start : p.start + p.length] for p in read(data)[0] if p.track == track])


def feature(samples_read: np.ndarray) -> str:
    """Level, spread, zero crossings and peak of the samples, and their counts in eight bands."""
    x = samples_read.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = np.bincount(samples_read >> 5, minlength=8).tolist()
    return f"{int(x.sum())},{int((x * x).sum())},{crossings},{int(np.abs(x).max(initial=0))}," + "/".join(map(str, bands))


# --- columns -----------------------------------------------------------------


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_bytes, media): texts padded with zero bytes to a positive multiple of 64, as media."""
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        media, sizes, ids, held = [], [], [], 0
        for k, text in enumerate(texts):
            raw = text.as_py()
            media.append(write_pcm(raw + bytes(-len(raw) % 64 or (64 if not raw else 0))))
            sizes.append(len(raw))
            ids.append(k)
            held += len(media[-1])
            if held > 8_000_000 or k == len(texts) - 1:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(ids)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )
                media, sizes, ids, held = [], [], [], 0


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, media) to what is read back from the media."""
    for batch in batches:
        out = []
        for cell in batch.column("media"):
            media = cell.as_py()
            packets, cues, _ = read(media)
            payload = b"".join([media[p.start : p.start + p.length] for p in packets if p.track == 1])
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(packets), len(cues)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in DIGEST.split(", ")]
        )


def to_media(docs: DataFrame) -> DataFrame:
    """Texts stored as media: doc_id, n_bytes, media.

    docs: doc_id, text; other columns are ignored. A null text is empty: 64 zero bytes. Rows stay
    rows; equal texts give equal media. No rows give no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests, checksums and a feature of what is read back from stored media."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(digests, DIGEST)


PACKETS = "doc_id long, track long, timestamp long, keyframe boolean, cluster long, start long, length long, time_ns long, duration_ns long, error string"


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of media files: doc_id, track, timestamp, keyframe, cluster, start, length, time_ns, duration_ns.

    media: doc_id, media. A null file has no packets. A file that can't be parsed, or is cut short, gives one row with
    what is wrong in error and nulls elsewhere.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if not cell.is_valid:
                    continue
                try:
                    rows += [(doc, *p, None) for p in read(cell.as_py())[0]]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((doc, *[None] * len(Packet._fields), str(e)))
            i = pa.int64()
            kinds = (i, i, i, pa.bool_(), i, i, i, i, i, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PACKETS.split(", ")]
            )

    return media.select("doc_id", "media").mapInArrow(of, PACKETS)
