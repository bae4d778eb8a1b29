"""Matroska columns: packet tables from EBML, and a lossless store of byte payloads as 8-bit PCM tracks.

The parser walks variable-length EBML elements (unknown sizes, Void and CRC-32 elements included), reads
tracks, clusters, simple blocks and block groups with all four kinds of lacing, and cues. It gives one row
per frame with track, timestamp and byte range, so that single frames can be read from a file's bytes.
The writer stores a payload as one track of unsigned 8-bit samples, frames laced into blocks, blocks in
clusters, and a cue for each cluster. The same payload always gives the same bytes.

Defined results: a null text is an empty payload; every payload is padded with bytes 0 to a positive
multiple of 64; a null or damaged file gives the packets before the damage (none for null); equal texts
give equal values; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

# Fixed values of the Matroska format: element IDs.
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID_LENGTH = 0x42F2
EBML_MAX_SIZE_LENGTH = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
FLAG_LACING = 0x9C
CODEC_ID = 0x86
DEFAULT_DURATION = 0x23E383
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
REFERENCE_BLOCK = 0xFB
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1

RATE = 8_000
#: Samples in a frame (128 ms), frames in a block and blocks in a cluster (16 s, as block times are 16 bits).
FRAME = 1_024
LACE = 8
CLUSTER_BLOCKS = 16
UNIT = 64


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones, which mean unknown, are left out."""
    if not width:
        width = 1
        while n >= (1 << 7 * width) - 1:
            width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _double(name: int, x: float) -> bytes:
    return _element(name, struct.pack(">d", x))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and body of a block that holds several frames."""
    sizes = [len(f) for f in frames]
    if kind == "none":
        return 0x00, frames[0]
    head = bytes([len(frames) - 1])
    if kind == "fixed":
        return 0x04, head + b"".join(frames)
    if kind == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    coded = [_size(sizes[0])]
    for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):  # differences, signed by an offset of half the range
        width = 1
        while abs(n - before) > (1 << 7 * width - 1) - 1:
            width += 1
        coded.append(_size(n - before + (1 << 7 * width - 1) - 1, width))
    return 0x06, head + b"".join(coded) + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, frames_per_block: int = LACE, uneven: str = "ebml") -> bytes:
    """A Matroska file of one track of 8-bit samples; payload is not empty."""
    head = _element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID_LENGTH, 4) + _uint(EBML_MAX_SIZE_LENGTH, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
    )
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _double(DURATION, len(payload) * 1000 / RATE) + _element(MUXING_APP, b"nearfield") + _element(WRITING_APP, b"nearfield"))
    audio = _element(AUDIO, _double(SAMPLING_FREQUENCY, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + audio)
    parts, at, cues = [info, _element(TRACKS, track)], 0, []
    at = sum(map(len, parts))
    block_bytes = frame * frames_per_block
    for start in range(0, len(payload), block_bytes * CLUSTER_BLOCKS):
        begins = start * 1000 // RATE
        blocks = [_uint(TIMESTAMP, begins)]
        for b in range(start, min(len(payload), start + block_bytes * CLUSTER_BLOCKS), block_bytes):
            frames = [payload[i : min(i + frame, b + block_bytes)] for i in range(b, min(len(payload), b + block_bytes), frame)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == frame else uneven
            flags, body = lace(frames, kind)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - begins, 0x80 | flags) + body))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begins) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join([*parts, _element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp ns, offset, size, keyframe, lacing, cluster number)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    complete: bool = True


class Damaged(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, width and next position of a variable-length integer."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep_marker else n ^ (1 << 7 * width)), width, at + width


def _children(data: bytes, at: int, end: int, stops: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int]]:
    """ID and byte range of each element; one of unknown size ends before an element of stops."""
    while at < end:
        name, width, at = _vint(data, at, end, True)
        if width > 4:
            raise Damaged(f"bad ID at {at}")
        n, width, at = _vint(data, at, end, False)
        if n == (1 << 7 * width) - 1:
            upto = _unknown_end(data, name, at, end)
        else:
            upto = at + n
        if upto > end:
            yield name, at, end
            raise Damaged(f"element at {at} is cut off")
        yield name, at, upto
        at = upto


def _unknown_end(data: bytes, name: int, at: int, end: int) -> int:
    if name != CLUSTER:
        return end
    while at < end:  # a cluster ends where the next element of the segment's level begins
        inner, _, body = _vint(data, at, end, True)
        if inner in (CLUSTER, CUES, TRACKS, INFO, SEGMENT):
            return at
        n, width, body = _vint(data, body, end, False)
        if n == (1 << 7 * width) - 1:
            return end
        at = body + n
    return end


def _int(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end - at in (4, 8) else 0.0


def _frames(data: bytes, at: int, end: int, lacing: int) -> tuple[str, list[tuple[int, int]]]:
    """Byte ranges (offset, size) of a block's frames."""
    if not lacing:
        return "none", [(at, end - at)]
    if at >= end:
        raise Damaged("laced block without a count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 0x04:
        if (end - at) % n:
            raise Damaged("uneven fixed lacing")
        sizes, kind = [(end - at) // n] * n, "fixed"
    elif lacing == 0x02:
        kind = "xiph"
        for _ in range(n - 1):
            total = 0
            while True:
                if at >= end:
                    raise Damaged("lace sizes are cut off")
                total, at = total + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(total)
    else:
        kind = "ebml"
        for i in range(n - 1):
            value, width, at = _vint(data, at, end, False)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    if len(sizes) < n:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("lace sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return kind, out


def _block(media: Media, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, _, at = _vint(data, at, end, False)
    if at + 3 > end:
        raise Damaged("block without a header")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    kind, ranges = _frames(data, at + 3, end, flags & 0x06)
    step = media.tracks.get(track, {}).get("default_duration", 0)
    when = (base + relative) * media.scale
    keyframe = bool(flags & 0x80) if key is None else key
    for i, (offset, size) in enumerate(ranges):
        media.packets.append((track, when + i * step, offset, size, keyframe, kind, len(media.clusters) - 1))


def parse(data: bytes) -> Media:
    """Everything up to the first damage; complete tells whether there was none."""
    media = Media()
    try:
        for name, at, end in _children(data, 0, len(data)):
            if name == EBML:
                for n, a, e in _children(data, at, end):
                    if n == DOC_TYPE:
                        media.doc_type = data[a:e].rstrip(b"\0").decode("ascii", "replace")
            elif name == SEGMENT:
                _segment(media, data, at, end)
    except Damaged:
        media.complete = False
    return media


def _segment(media: Media, data: bytes, start: int, stop: int) -> None:
    for name, at, end in _children(data, start, stop):
        if name == INFO:
            for n, a, e in _children(data, at, end):
                if n == TIMESTAMP_SCALE:
                    media.scale = _int(data, a, e)
                elif n == DURATION:
                    media.duration = _float(data, a, e)
        elif name == TRACKS:
            for n, a, e in _children(data, at, end):
                if n == TRACK_ENTRY:
                    _track(media, data, a, e)
        elif name == CLUSTER:
            base = 0
            media.clusters.append(at)
            for n, a, e in _children(data, at, end):
                if n == TIMESTAMP:
                    base = _int(data, a, e)
                elif n == SIMPLE_BLOCK:
                    _block(media, data, a, e, base, None)
                elif n == BLOCK_GROUP:
                    inner = list(_children(data, a, e))
                    refers = any(x == REFERENCE_BLOCK for x, _, _ in inner)
                    for x, b, c in inner:
                        if x == BLOCK:
                            _block(media, data, b, c, base, not refers)
        elif name == CUES:
            for n, a, e in _children(data, at, end):
                if n == CUE_POINT:
                    when = 0
                    for x, b, c in _children(data, a, e):
                        if x == CUE_TIME:
                            when = _int(data, b, c) * media.scale
                        elif x == CUE_TRACK_POSITIONS:
                            found = {y: _int(data, d, f) for y, d, f in _children(data, b, c)}
                            media.cues.append((when, found.get(CUE_TRACK, 0), start + found.get(CUE_CLUSTER_POSITION, 0)))


def _track(media: Media, data: bytes, at: int, end: int) -> None:
    track: dict = {}
    for n, a, e in _children(data, at, end):
        if n == TRACK_NUMBER:
            track["number"] = _int(data, a, e)
        elif n == TRACK_TYPE:
            track["type"] = _int(data, a, e)
        elif n == CODEC_ID:
            track["codec"] = data[a:e].rstrip(b"\0").decode("ascii", "replace")
        elif n == DEFAULT_DURATION:
            track["default_duration"] = _int(data, a, e)
        elif n == AUDIO:
            for x, b, c in _children(data, a, e):
                if x == SAMPLING_FREQUENCY:
                    track["rate"] = _float(data, b, c)
                elif x == CHANNELS:
                    track["channels"] = _int(data, b, c)
                elif x == BIT_DEPTH:
                    track["bits"] = _int(data, b, c)
    media.tracks[track.get("number", 0)] = track


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames in the order of the file."""
    view = memoryview(data)
    return b"".join([view[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track])


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature_of(media: Media, payload: bytes) -> str:
    laced = sum(p[5] != "none" for p in media.packets)
    end = max((p[1] // 1_000_000 + p[3] * 1000 // RATE for p in media.packets), default=0)
    mean = sum(payload) / len(payload) if len(payload) else 0.0
    return f"tracks={len(media.tracks)};packets={len(media.packets)};laced={laced};clusters={len(media.clusters)};cues={len(media.cues)};ms={end};mean={mean:.3f}"


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a Matroska file, read it back and describe what was read, one row per row of docs."""
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                media = mux(pad(raw))
                parsed = parse(media)
                back = payload_of(media, parsed)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(parsed, back)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    schema = f"id {light.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return light.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with each text as a Matroska file in media_col, with an underscore more where docs have such a column."""
    media_col = free_name(docs, media_col)
    place, names = docs.columns.index(text_col), [*docs.columns, media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                media = [mux(pad((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(media_col, T.BinaryType())]))


def packet_table(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per frame of each file: id_col, packet, track, codec, timestamp_ns, offset, size, keyframe, lacing, cluster, cue."""
    light = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = f"id {light.schema['id'].dataType.simpleString()}, packet int, track int, codec string, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, cluster int, cue boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_()]
        for batch in batches:
            for row in range(batch.num_rows):  # a batch for each file, so that memory is bounded by one file's packets
                media = parse(batch.column(1)[row].as_py() or b"")
                cued = {when for when, _, _ in media.cues}
                rows = [(i, t, media.tracks.get(t, {}).get("codec"), when, offset, size, key, kind, cluster, when in cued) for i, (t, when, offset, size, key, kind, cluster) in enumerate(media.packets)]
                ids = batch.column(0).take(pa.array([row] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=schema_names)

    schema_names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return light.mapInArrow(run, schema).withColumnRenamed("id", id_col)
