"""Media columns: Matroska files in a binary column, and their packet tables.

``mux`` stores a payload as one track of unsigned 8-bit PCM samples: an EBML header,
then a segment with info, tracks, clusters of simple blocks and cues.  Blocks hold
several frames by lacing (fixed-size where all frames are equal, else EBML).
``packets`` walks the elements of any Matroska file and gives one row a frame, with track, timestamp, key flag and byte range; ``cues`` gives the seek table.  The
payload is what the packets' byte ranges hold, read from the stored bytes.

The walk follows element sizes and never searches for patterns, so its cost is that of
the elements; a truncated or foreign file ends the walk with the packets found so far
and an ``error``.

Defined cases: a null payload counts as empty and is padded to 64 zero bytes; null media
gives no packets and ``error`` "no data".  Equal payloads give equal files (nothing
depends on time or identity).  Each row is handled alone, so repeated rows repeat, and an empty
table gives an empty one.  A segment or cluster of unknown size, as in live streams, ends before
the next element that it cannot hold.  Other columns stay; those named like an added one are
replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import prepare

#: Element ids fixed by the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP_SCALE, TRACK_NUMBER, DOC_TYPE = 0x2AD7B1, 0xD7, 0x4282
#: What may have no size, and the ids that end it: those of its own level and above.
_FILE = {EBML, SEGMENT}
_TOP = _FILE | {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
ENDED_BY = {SEGMENT: _FILE, CLUSTER: _TOP}

PAD = 64
#: Samples a second: one sample a millisecond tick of the default scale is too coarse for long payloads' clusters.
RATE = 8000
FRAME, FRAMES, BLOCKS = 512, 8, 16


def pad(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ``PAD``."""
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def _size(n: int) -> bytes:
    """A variable-length size of the fewest bytes; all ones are reserved."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    """A difference of lace sizes, stored with a bias of half the range."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return _size_fixed(n + (1 << 7 * width - 1) - 1, width)


def _size_fixed(n: int, width: int) -> bytes:
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and body of a block."""
    if len(frames) == 1:
        return 0, frames[0]
    count, body = bytes([len(frames) - 1]), b"".join(frames)
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, count + body
    steps = b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return 0x06, count + _size(sizes[0]) + steps + body


_HEADER = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK,
        _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _element(0x86, b"A_PCM/INT/LIT")
        + _element(0xE1, _element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of the payload's bytes as samples, ``FRAME`` a frame."""
    ticks = lambda samples: samples * 1000 // RATE
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(0x4D80, b"tidemark") + _element(0x5741, b"tidemark"))
    head = info + _TRACKS
    per_block, per_cluster = FRAME * FRAMES, FRAME * FRAMES * BLOCKS
    body, at, points = [head], len(head), []
    for lo in range(0, len(payload), per_cluster):
        parts = [_uint(TIMESTAMP, ticks(lo))]
        for start in range(lo, min(lo + per_cluster, len(payload)), per_block):
            stop = min(start + per_block, lo + per_cluster, len(payload))
            lacing, data = _lace([payload[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)])
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ticks(start) - ticks(lo), 0x80 | lacing) + data))
        cluster = _element(CLUSTER, b"".join(parts))
        points.append(_element(CUE_POINT, _uint(CUE_TIME, ticks(lo)) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(points)))
    return _HEADER + _element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """Value, end and whether all value bits are ones, of a variable-length integer."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    raw, ones = int.from_bytes(data[at : at + width], "big"), (1 << 7 * width) - 1
    return (raw if keep else raw & ones), at + width, raw & ones == ones


def _reach(data: bytes, at: int, stop: int, ident: int) -> int:
    """Where an element of unknown size ends: before the next element that it cannot hold, or with its parent."""
    while at < stop:
        try:
            child, body, _ = _vint(data, at, True)
            if child in ENDED_BY[ident]:
                return at
            size, body, unknown = _vint(data, body, False)
        except ValueError:
            return stop
        at = _reach(data, body, stop, child) if unknown and child in ENDED_BY else body + size
    return stop


def elements(data: bytes, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """``id, start, end`` of the bodies in a range, of known and unknown sizes."""
    while at < stop:
        ident, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at, False)
        if unknown and ident not in ENDED_BY:
            raise ValueError(f"element {ident:x} has no size")
        end = _reach(data, at, stop, ident) if unknown else at + size
        if end > stop:
            raise ValueError(f"element {ident:x} runs past its parent at {at}")
        yield ident, at, end
        at = end


def _frames(data: bytes, at: int, stop: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, key flag and byte ranges of a block's frames, for every lacing."""
    track, at, _ = _vint(data, at, False)
    if at + 3 > stop:
        raise ValueError(f"block cut off at {at}")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80), [(at, stop)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3:
        for i in range(count - 1):
            start = at
            n, at, _ = _vint(data, at, False)
            sizes.append(n if not i else sizes[-1] + n - (1 << 7 * (at - start) - 1) + 1)
    else:
        if (stop - at) % count:
            raise ValueError(f"{count} frames of one size don't fill the block at {at}")
        sizes = [(stop - at) // count] * (count - 1)
    ranges = []
    for n in sizes:
        ranges.append((at, at + n))
        at += n
    if at > stop or any(n < 0 for n in sizes):
        raise ValueError(f"lace runs past its block at {at}")
    return track, time, bool(flags & 0x80), [*ranges, (at, stop)]


def packet_rows(data: bytes | None) -> tuple[list[tuple[int, int, bool, int, int]], list[tuple[int, int, int]], str | None]:
    """Packets (track, timestamp, key, first byte, length), cues (time, track, cluster byte) and an error."""
    packets: list[tuple[int, int, bool, int, int]] = []
    cues: list[tuple[int, int, int]] = []
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    if not data:
        return packets, cues, "no data"
    try:
        for ident, a, b in elements(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            for kind, c, d in elements(data, a, b):
                if kind == CLUSTER:
                    base = 0
                    for inner, e, f in elements(data, c, d):
                        if inner == TIMESTAMP:
                            base = number(e, f)
                        blocks = [(e, f)] if inner == SIMPLE_BLOCK else [(g, h) for i, g, h in elements(data, e, f) if i == BLOCK] if inner == BLOCK_GROUP else []
                        for e, f in blocks:
                            track, time, key, ranges = _frames(data, e, f)
                            packets += [(track, base + time, key, x, y - x) for x, y in ranges]
                elif kind == CUES:
                    for point, e, f in elements(data, c, d):
                        found = {i: (g, h) for i, g, h in elements(data, e, f)} if point == CUE_POINT else {}
                        if CUE_TIME in found and CUE_POSITIONS in found:
                            place = {i: number(g, h) for i, g, h in elements(data, *found[CUE_POSITIONS])}
                            cues.append((number(*found[CUE_TIME]), place.get(CUE_TRACK, 0), a + place.get(CUE_CLUSTER, 0)))
    except (ValueError, IndexError, struct.error) as e:
        return packets, cues, str(e) or type(e).__name__
    return packets, cues, None


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        raw = [(x or "").encode() for x in rows.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded UTF-8 bytes as a Matroska file."""
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_mux, "doc_id long, n_bytes long, media binary")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("track", pa.int64()), ("timestamp", pa.int64()), ("key", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())]))
    point = pa.list_(pa.struct([("timestamp", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())]))
    for rows in batches:
        read = [packet_rows(x) for x in rows.column(rows.num_columns - 1).to_pylist()]
        names = ("track", "timestamp", "key", "offset", "length")
        yield pa.RecordBatch.from_arrays(
            [
                *rows.columns,
                pa.array([[dict(zip(names, p, strict=True)) for p in x[0]] for x in read], kind),
                pa.array([[dict(zip(("timestamp", "track", "offset"), c, strict=True)) for c in x[1]] for x in read], point),
                pa.array([x[2] for x in read], pa.string()),
            ],
            names=[*rows.schema.names, "packets", "cues", "error"],
        )


def packets(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with its ``column`` last, and ``packets``, ``cues`` and ``error`` from it."""
    kept = [F.col(c) for c in media.columns if c not in (column, "packets", "cues", "error")]
    rows = media.select(*kept, F.col(column))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    extra = "packets array<struct<track: bigint, timestamp: bigint, key: boolean, offset: bigint, length: bigint>>, cues array<struct<timestamp: bigint, track: bigint, offset: bigint>>, error string"
    return rows.mapInArrow(_packets, f"{fields}, {extra}")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for media, ranges, cues in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            payload = b"".join([media[p["offset"] : p["offset"] + p["length"]] for p in ranges])
            last = ranges[-1]["timestamp"] if ranges else 0
            feature = f"packets={len(ranges)};clusters={len(cues)};last={last};tracks={len({p['track'] for p in ranges})};mean={sum(payload) / max(1, len(payload)):.4f}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digest(stored: DataFrame) -> DataFrame:
    """The columns of the contract, from the packets of :func:`store`'s files."""
    read = packets(stored).select("doc_id", "n_bytes", "media", "packets", "cues")
    return read.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
