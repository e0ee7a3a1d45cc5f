"""Media columns: Matroska files as binary columns, parsed into packet tables.

`parse` walks the variable-length EBML elements of one file and returns its
tracks, its packets (track, timestamp, byte range of each frame, whatever the
lacing) and its cue points.  `with_packets` applies it to a binary column;
`packet_table` has one row for each packet.  `mux_bytes` writes a payload as
8-bit PCM audio in frames of 576 samples, with clusters, laced blocks and cues.

Defined results: a null or empty file has no tracks, packets or cues and the
error "empty"; a file that ends early keeps the packets that are whole, and
names the fault in `error`.  A very long text is one file, held whole in its task
with its packets, a few times its length.  Repeated rows give repeated results; other columns
of the input are left out unless named in `keys`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import slices

FRAME = 576
#: Samples a second and milliseconds a frame.
RATE, FRAME_MS = 8000, 72
FRAMES_A_BLOCK, FRAMES_A_CLUSTER = 8, 400

# Fixed values of the container format: element identifiers.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}


# --- writing ---------------------------------------------------------------


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, payload: bytes) -> bytes:
    return _id(number) + _size(len(payload)) + payload


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(number: int, value: float) -> bytes:
    return element(number, struct.pack(">d", value))


def _signed_size(delta: int) -> bytes:
    """The difference of two sizes in EBML lacing: a vint shifted so that it may be negative."""
    width = 1
    while not -(1 << 7 * width - 1) < delta < 1 << 7 * width - 1:
        width += 1
    return (delta + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def block(track: int, relative: int, frames: list[bytes], lacing: int, flags: int = 0x80) -> bytes:
    """A block's content. lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    head = _size(track) + struct.pack(">hB", relative, flags | lacing << 1)
    if not lacing:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == 1:
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    elif lacing == 3:
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-1], sizes[1:-1]))
    return head + b"".join(frames)


_HEADER = element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(AUDIO, _float(SAMPLING_FREQUENCY, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def padded(data: bytes) -> bytes:
    """`data` with bytes 255 up to a positive multiple of the frame's size."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def mux_bytes(payload: bytes) -> bytes:
    """A Matroska file whose only track holds `payload`, a multiple of 576 bytes, as 8-bit samples."""
    n = len(payload) // FRAME
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, float(n * FRAME_MS)) + element(MUXING_APP, b"lightshelf") + element(WRITING_APP, b"lightshelf"))
    parts, cues, at, count = [info, _TRACKS], [], len(info) + len(_TRACKS), 0
    for first in range(0, n, FRAMES_A_CLUSTER):
        blocks = [_uint(CLUSTER_TIMESTAMP, first * FRAME_MS)]
        last = min(n, first + FRAMES_A_CLUSTER)
        for k in range(first, last, FRAMES_A_BLOCK):
            frames = [payload[i * FRAME : (i + 1) * FRAME] for i in range(k, min(last, k + FRAMES_A_BLOCK))]
            lacing = (1, 3, 2)[count % 3] if len(frames) > 1 else 0
            count += 1
            blocks.append(element(SIMPLE_BLOCK, block(1, (k - first) * FRAME_MS, frames, lacing)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


# --- reading ---------------------------------------------------------------


class Fault(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length number and the place after it; sizes of ones only are -1 (unknown)."""
    if at >= end:
        raise Fault("ends inside a number")
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > end or (keep_marker and width > 4):
        raise Fault("no valid number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, first byte of the content, end, whole) of the elements of data[at:end].

    Elements of unknown size reach to the next one of `stop` or to the end.
    """
    while at < end:
        number, body = _vint(data, at, end, True)
        size, body = _vint(data, body, end, False)
        if size < 0:
            over = _unknown_end(data, body, end, number)
        else:
            over = body + size
        yield number, body, min(over, end), over <= end
        at = over


def _unknown_end(data: bytes, at: int, end: int, number: int) -> int:
    """Where an element of unknown size ends: a cluster at the next top-level element, others at the end."""
    if number != CLUSTER:
        return end
    while at < end:
        inner, body = _vint(data, at, end, True)
        if inner in TOP_LEVEL:
            return at
        size, body = _vint(data, body, end, False)
        if size < 0:
            return end
        at = body + size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[int]]:
    """Track, relative timestamp, flags, place of the first frame, and the frames' sizes of a block."""
    track, at = _vint(data, at, end, False)
    if at + 3 > end:
        raise Fault("block ends early")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, at, [end - at]
    if at >= end:
        raise Fault("block ends early")
    count = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % count:
            raise Fault("fixed lacing of unequal frames")
        return track, relative, flags, at, [(end - at) // count] * count
    sizes = []
    if lacing == 1:
        for _ in range(count - 1):
            s = 0
            while True:
                if at >= end:
                    raise Fault("lacing ends early")
                s += data[at]
                at += 1
                if data[at - 1] < 255:
                    break
            sizes.append(s)
    elif count > 1:
        s, at = _vint(data, at, end, False)
        sizes.append(s)
        for _ in range(count - 2):
            if at >= end or not data[at]:
                raise Fault("lacing ends early")
            width = 9 - data[at].bit_length()
            s += (int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1) - (1 << 7 * width - 1) + 1
            at += width
            sizes.append(s)
    rest = end - at - sum(sizes)
    if rest < 0 or any(s < 0 for s in sizes):
        raise Fault("lacing exceeds its block")
    return track, relative, flags, at, [*sizes, rest]


def parse(data: bytes | None) -> dict:
    """Tracks, packets and cues of one file; see the module's text for faulty ones.

    A packet is (track, timestamp in ns, first byte, size, keyframe, lacing, cluster's first byte).
    """
    out = {"tracks": [], "packets": [], "cues": [], "error": None}
    if not data:
        return out | {"error": "empty"}
    scale = 1_000_000
    raw_cues: list[tuple[int, int, int]] = []
    durations: dict[int, int] = {}
    try:
        start = next(elements(data, 0, len(data)))
        if start[0] != EBML:
            return out | {"error": "no EBML header"}
        out["error"] = "no segment"
        for number, a, b, whole in elements(data, start[2], len(data)):
            if number != SEGMENT:
                continue
            base = a
            out["error"] = None if whole else "segment ends early"
            for kind, c, d, all_there in elements(data, a, b):
                if not all_there:
                    out["error"] = "element ends early"
                if kind == INFO:
                    for k, x, y, _ in elements(data, c, d):
                        if k == TIMESTAMP_SCALE:
                            scale = _number(data, x, y)
                elif kind == TRACKS:
                    for k, x, y, _ in elements(data, c, d):
                        if k == TRACK_ENTRY:
                            out["tracks"].append(_track(data, x, y, durations))
                elif kind == CLUSTER:
                    _cluster(data, c, d, scale, durations, out["packets"])
                elif kind == CUES:
                    for k, x, y, _ in elements(data, c, d):
                        if k == CUE_POINT:
                            _cue(data, x, y, raw_cues)
            out["cues"] = [(track, time * scale, base + place) for time, track, place in raw_cues]
    except (Fault, StopIteration) as e:
        out["error"] = str(e) or "no element"
    return out


def _track(data: bytes, a: int, b: int, durations: dict[int, int]) -> tuple[int, int, str, float, int, int]:
    got, audio = {}, {}
    for k, x, y, _ in elements(data, a, b):
        if k == AUDIO:
            for q, u, v, _ in elements(data, x, y):
                audio[q] = _real(data, u, v) if q == SAMPLING_FREQUENCY else _number(data, u, v)
        elif k == CODEC_ID:
            got[k] = data[x:y].rstrip(b"\0").decode("utf-8", "replace")
        elif k in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            got[k] = _number(data, x, y)
    durations[got.get(TRACK_NUMBER, 0)] = got.get(DEFAULT_DURATION, 0)
    return got.get(TRACK_NUMBER, 0), got.get(TRACK_TYPE, 0), got.get(CODEC_ID, ""), audio.get(SAMPLING_FREQUENCY, 0.0), audio.get(CHANNELS, 0), audio.get(BIT_DEPTH, 0)


def _cluster(data: bytes, a: int, b: int, scale: int, durations: dict[int, int], packets: list) -> None:
    time = 0
    for kind, c, d, whole in elements(data, a, b):
        if kind == CLUSTER_TIMESTAMP:
            time = _number(data, c, d)
        elif kind == SIMPLE_BLOCK:
            if not whole:
                raise Fault("block ends early")
            _block(data, c, d, time, scale, durations, a, True, packets)
        elif kind == BLOCK_GROUP:
            for k, x, y, all_there in elements(data, c, d):
                if k == BLOCK:
                    if not all_there:
                        raise Fault("block ends early")
                    _block(data, x, y, time, scale, durations, a, False, packets)


def _block(data: bytes, a: int, b: int, time: int, scale: int, durations: dict[int, int], cluster: int, simple: bool, packets: list) -> None:
    track, relative, flags, at, sizes = _frames(data, a, b)
    each = durations.get(track, 0)
    start = (time + relative) * scale
    for i, size in enumerate(sizes):
        packets.append((track, start + i * each, at, size, bool(simple and flags & 0x80), flags >> 1 & 3, cluster))
        at += size


def _cue(data: bytes, a: int, b: int, cues: list) -> None:
    time = 0
    for k, x, y, _ in elements(data, a, b):
        if k == CUE_TIME:
            time = _number(data, x, y)
        elif k == CUE_TRACK_POSITIONS:
            got = {q: _number(data, u, v) for q, u, v, _ in elements(data, x, y) if q in (CUE_TRACK, CUE_CLUSTER_POSITION)}
            cues.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))


# --- columns ---------------------------------------------------------------

PACKETS = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster_offset", pa.int64())]))
TRACK_ROWS = pa.list_(pa.struct([("track", pa.int32()), ("kind", pa.int32()), ("codec", pa.string()), ("rate", pa.float64()), ("channels", pa.int32()), ("bit_depth", pa.int32())]))
CUE_ROWS = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("cluster_offset", pa.int64())]))
PACKETS_DDL = "array<struct<track:int,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:int,cluster_offset:bigint>>"
TRACKS_DDL = "array<struct<track:int,kind:int,codec:string,rate:double,channels:int,bit_depth:int>>"
CUES_DDL = "array<struct<track:int,timestamp_ns:bigint,cluster_offset:bigint>>"


def _structs(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
    return pa.array([[dict(zip(names, x)) for x in row] for row in rows], kind)


def with_packets(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys` of each row with arrays `tracks`, `packets` and `cues` of its file, and `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_media"):
            got = [parse(x) for x in batch.column("_media").to_pylist()]
            columns = [batch.column(k) for k in keys] + [_structs([g["tracks"] for g in got], TRACK_ROWS), _structs([g["packets"] for g in got], PACKETS), _structs([g["cues"] for g in got], CUE_ROWS), pa.array([g["error"] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "tracks", "packets", "cues", "error"])

    held = df.select(*[F.col(k) for k in keys], F.col(media).cast("binary").alias("_media"))
    kinds = "".join(f"`{k}` {t}, " for k, t in held.dtypes[:-1])
    return held.mapInArrow(run, f"{kinds}tracks {TRACKS_DDL}, packets {PACKETS_DDL}, cues {CUES_DDL}, error string")


def packet_table(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each packet of each file, with its place in the file's order."""
    rows = with_packets(df, media, keys).select(*keys, F.posexplode("packets").alias("packet", "p"))
    return rows.select(*keys, "packet", "p.*")


def mux(df: DataFrame, payload: str | Column, keys: tuple[str, ...] = (), media: str = "media") -> DataFrame:
    """`keys` of each row and a Matroska file of its (padded) text or bytes; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_payload"):
            files = [mux_bytes(padded(x or b"")) for x in batch.column("_payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(files, pa.binary())], [*keys, media])

    column = F.col(payload) if isinstance(payload, str) else payload
    held = df.select(*[F.col(k) for k in keys], column.cast("binary").alias("_payload"))
    kinds = "".join(f"`{k}` {t}, " for k, t in held.dtypes[:-1])
    return held.mapInArrow(run, f"{kinds}`{media}` binary")


def feature(samples: np.ndarray, n_packets: int, n_tracks: int, n_cues: int, last_ns: int) -> str:
    """Packets, tracks, cues, length and level of 8-bit samples, as one string."""
    x = samples.astype(np.float64)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    return f"packets={n_packets};tracks={n_tracks};cues={n_cues};ms={last_ns // 1_000_000 + FRAME_MS};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


def media_features(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """Reads the payload back from the byte ranges of each file's packets, with digests and features.

    An unreadable file gives an empty payload and the feature "unreadable".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_media"):
            rows = []
            for data in batch.column("_media").to_pylist():
                got = parse(data)
                packets = got["packets"]
                payload = b"".join(data[p[2] : p[2] + p[3]] for p in packets) if packets else b""
                text = feature(np.frombuffer(payload, np.uint8), len(packets), len(got["tracks"]), len(got["cues"]), packets[-1][1]) if payload else "unreadable"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), text, len(packets)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + columns, [*keys, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"])

    held = df.select(*[F.col(k) for k in keys], F.col(media).cast("binary").alias("_media"))
    kinds = "".join(f"`{k}` {t}, " for k, t in held.dtypes[:-1])
    return held.mapInArrow(run, f"{kinds}payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and n_bytes of documents with the features of their texts as stored media; null texts count as empty."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint")).alias("n_bytes"), "text")
    files = mux(rows, "text", ("doc_id", "n_bytes"))
    return media_features(files, "media", ("doc_id", "n_bytes"))
