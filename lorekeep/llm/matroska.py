"""Media columns: text bytes kept losslessly as 8-bit samples in Matroska, and a Matroska parser.

The parser walks variable-length EBML elements, clusters, all four kinds of lacing and the cues,
and gives a packet table: track, timestamp and byte range of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

# Element ids of the container format.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
#: Samples a frame and a second; frames a block; blocks a cluster (so that 16-bit offsets in ms suffice).
FRAME, HERTZ, LACED, BLOCKS = 576, 8000, 8, 48


# -- writing --------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and the body of a block of several frames."""
    if len(frames) == 1 or lacing == "none":
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == "fixed":
        return 0x04, head + b"".join(frames)
    if lacing == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    out = head + vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, out + b"".join(frames)


def write(payload: bytes, lacing: str = "fixed") -> bytes:
    """A file with one track of 8-bit PCM: 576 samples a frame, 8 frames a block, cues by cluster."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    step = FRAME * 1000 // HERTZ
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * step)) + element(0x4D80, b"lorekeep") + element(0x5741, b"lorekeep"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, step * 1_000_000) + audio))
    body, cues = info + tracks, b""
    many = 1 if lacing == "none" else LACED
    for c in range(0, len(frames), many * BLOCKS):
        start = c * step
        cues += element(CUE, number(CUE_TIME, start) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body))))
        blocks = [number(TIMESTAMP, start)]
        for b in range(c, min(c + many * BLOCKS, len(frames)), many):
            flags, data = laced(frames[b : b + many], lacing)
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", b * step - start, 0x80 | flags) + data))
        body += element(CLUSTER, b"".join(blocks))
    return head + element(SEGMENT, body + element(CUES, cues))


# -- parsing --------------------------------------------------------------------------------------


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """(value, next place): an id with its length marker kept, or a size; None for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no element at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep:
        return raw, at + width
    n = raw & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lace: int


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    segment: int = 0
    tracks: list[dict] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: int = 0


def frame_ranges(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame in a block's body."""
    kind = flags & 0x06
    if not kind:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == 0x04:
        size = (end - at) // n
        return [(at + i * size, size) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 0x02:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length()
            raw, at = read_vint(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size = raw if i == 0 else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return [*out, (at, end - at)]


def parse(data: bytes) -> Media:
    """Walk a whole file. Unknown sizes of segment and cluster run to the next element of their level."""
    m = Media()
    cluster_time, cue = 0, [0, 0, 0]
    durations: dict[int, int] = {}
    at, end = 0, len(data)
    while at < end:
        begin = at
        kind, at = read_vint(data, at, keep=True)
        size, at = read_vint(data, at)
        if kind in MASTERS:  # its children come next; where it ends doesn't matter to what they say
            if kind == SEGMENT:
                m.segment = at
            elif kind == TRACK:
                m.tracks.append({"number": 0, "kind": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0})
            elif kind == CLUSTER:
                m.clusters.append(begin - m.segment)
            elif kind == CUE:
                cue = [0, 0, 0]
            continue
        if size is None:
            raise ValueError(f"element {kind:x} at byte {begin} has no size")
        stop = at + size
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {begin} is cut off")
        value = lambda: int.from_bytes(data[at:stop], "big")  # noqa: E731, B023
        real = lambda: struct.unpack(">f" if size == 4 else ">d", data[at:stop])[0] if size else 0.0  # noqa: E731, B023
        if kind in (SIMPLE, BLOCK):
            track, body = read_vint(data, at)
            offset, flags = struct.unpack_from(">hB", data, body)
            start = (cluster_time + offset) * m.scale
            step = durations.get(track, 0)
            m.blocks += 1
            for i, (a, n) in enumerate(frame_ranges(data, body + 3, stop, flags)):
                m.packets.append(Packet(track, start + i * step, a, n, bool(flags & 0x80) or kind == BLOCK, i))
        elif kind == TIMESTAMP:
            cluster_time = value()
        elif kind == SCALE:
            m.scale = value()
        elif kind == DURATION:
            m.duration = real()
        elif kind == DOC_TYPE:
            m.doc_type = data[at:stop].decode()
        elif kind == NUMBER:
            m.tracks[-1]["number"] = value()
        elif kind == KIND:
            m.tracks[-1]["kind"] = value()
        elif kind == CODEC:
            m.tracks[-1]["codec"] = data[at:stop].decode()
        elif kind == RATE:
            m.tracks[-1]["rate"] = real()
        elif kind == CHANNELS:
            m.tracks[-1]["channels"] = value()
        elif kind == DEPTH:
            m.tracks[-1]["depth"] = value()
        elif kind == DEFAULT_DURATION:
            durations[m.tracks[-1]["number"]] = value()
        elif kind == CUE_TIME:
            cue[0] = value()
        elif kind == CUE_TRACK:
            cue[1] = value()
        elif kind == CUE_CLUSTER:
            cue[2] = value()
            m.cues.append(tuple(cue))
        at = stop
    return m


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: empty) with bytes 255 up to a positive multiple of 576; its own length."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def features(m: Media, payload: bytes) -> str:
    """What packets and samples say, as one string: counts, duration, level, crossings, energy by quarter."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = [int((q * q).sum()) for q in np.array_split(x, 4)]
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"packets={len(m.packets)};blocks={m.blocks};clusters={len(m.clusters)};cues={len(m.cues)};ms={m.duration:.0f};sum={int(x.sum())};crossings={crossings};energy={','.join(map(str, energy))}"


# -- columns --------------------------------------------------------------------------------------

PACKETS = "array<struct<track:int,timestamp_ns:bigint,offset:bigint,size:int,keyframe:boolean,lace:int>>"


def to_media(docs: DataFrame, *, lacing: str = "fixed") -> DataFrame:
    """docs plus `media` (binary), the whole text as a Matroska file; a null text is empty."""

    @F.pandas_udf("binary")
    def media(texts):
        return texts.map(lambda t: write(padded(t)[0], lacing))

    return docs.withColumn("media", media("text"))


def packet_table(media: DataFrame) -> DataFrame:
    """media plus `packets`, an array with track, timestamp and byte range of each frame (null media: null)."""

    @F.pandas_udf(PACKETS)
    def packets(files):
        return files.map(lambda b: None if b is None else [vars(p) for p in parse(b).packets])

    return media.withColumn("packets", packets("media"))


def media_digest(docs: DataFrame, *, lacing: str = "fixed") -> DataFrame:
    """Store every whole text as Matroska, read the bytes back, and describe both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. A null or empty text is a payload of 576 bytes 255. Repeated rows give equal rows;
    other columns are ignored. Work and memory follow single texts; nothing is shuffled.
    """
    bounded(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                out: list[list] = [[] for _ in names]
                for d, t in zip(batch.column(0).slice(i, 1024).to_pylist(), batch.column(1).slice(i, 1024).to_pylist()):
                    payload, n = padded(t)
                    stored = write(payload, lacing)
                    m = parse(stored)
                    back = b"".join(stored[p.offset : p.offset + p.size] for p in m.packets)
                    row = (d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(m, back))
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
