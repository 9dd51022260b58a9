"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`parse` walks variable-length EBML elements (known and unknown sizes), opens
clusters, undoes all four lacing modes of Block and SimpleBlock and reads the
cues. `mux` stores a byte payload losslessly as 8-bit PCM samples; it uses every
lacing mode in turn so that a round trip exercises the whole parser.
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

from .common import slices, table

#: Samples in the smallest frame, and the sampling rate: 192 samples are 24 ms.
FRAME, RATE = 192, 8000
#: Payload bytes that one cluster holds at most; 32,767 ms is what a block can be apart.
CLUSTER_BYTES = FRAME * 256

# Element identifiers of the Matroska specification.
EBML, DOCTYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
DEFAULT_DURATION, REFERENCE_BLOCK = 0x23E383, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = {NO_LACING: "none", XIPH: "xiph", FIXED: "fixed", EBML_LACING: "ebml"}


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp_ms, keyframe, lacing, offset, size)."""

    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration_ms: float = 0.0
    scale_ns: int = 1_000_000


def vint(value: int, width: int = 0) -> bytes:
    """value as an EBML size; the pattern of all ones stays free, as it means unknown."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """The number at `at` without its length marker, and its width."""
    first = data[at]
    if not first:
        raise ValueError("a number of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("a number beyond the end")
    return int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1), width


def element(ident: int, payload: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(sizes: list[int], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return b""
    head = bytes([len(sizes) - 1])
    if lacing == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == EBML_LACING:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head


def _block(track: int, relative: int, lacing: int, frames: list[bytes]) -> bytes:
    return vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + _laced([*map(len, frames)], lacing) + b"".join(frames)


#: Frame lengths, in units of FRAME, and the lacing of the blocks that follow each other.
_PLAN = (([1, 2, 1, 3], XIPH), ([2, 1, 4, 1], EBML_LACING), ([1, 1, 1, 1], FIXED), ([4], NO_LACING))


def mux(payload: bytes) -> bytes:
    """payload (a positive multiple of FRAME) as a Matroska file with one 8-bit track."""
    clusters, cues, at, turn = [], [], 0, 0
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(SAMPLING, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    head = info + element(TRACKS, element(TRACK_ENTRY, entry))
    place = len(head)
    for start in range(0, len(payload), CLUSTER_BYTES):
        end, base = min(len(payload), start + CLUSTER_BYTES), start * 1000 // RATE
        body = [unsigned(TIMESTAMP, base)]
        at = start
        while at < end:
            plan, lacing = _PLAN[turn % 4]
            turn += 1
            frames, when = [], at * 1000 // RATE - base
            for units in plan:
                if at < end:
                    frames.append(payload[at : min(end, at + units * FRAME)])
                    at += len(frames[-1])
            lacing = NO_LACING if len(frames) == 1 else lacing
            if lacing == XIPH:
                body.append(element(BLOCK_GROUP, element(BLOCK, _block(1, when, lacing, frames))))
            else:
                lacing = EBML_LACING if lacing == FIXED and len({*map(len, frames)}) > 1 else lacing
                body.append(element(SIMPLE_BLOCK, _block(1, when, lacing, frames)))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, base) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, place))))
        place += len(clusters[-1])
    return element(EBML, element(DOCTYPE, b"matroska")) + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


def _head(data: bytes, at: int) -> tuple[int, int, int]:
    """Identifier, start of the payload and its size, -1 if unknown."""
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element at {at}")
    size, w = read_vint(data, at + width)
    return int.from_bytes(data[at : at + width], "big"), at + width + w, -1 if size == (1 << 7 * w) - 1 else size


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the next element of the top level, in one pass over its own."""
    while at < end:
        ident, payload, size = _head(data, at)
        if ident in TOP_LEVEL:
            return at
        if size < 0:
            return end
        at = payload + size
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start, start of payload, end) of each element in data[at:end].

    An element of unknown size ends where its parent does or where another element
    of the top level starts, for a cluster.
    """
    while at < end:
        start = at
        ident, at, size = _head(data, start)
        stop = at + size if size >= 0 else _cluster_end(data, at, end) if ident == CLUSTER else end
        if stop > end:
            if ident in (SEGMENT, CLUSTER):  # what there is of it is read before the fault is told
                yield ident, start, at, end
            raise ValueError(f"the element at {start} is longer than its parent")
        yield ident, start, at, stop
        at = stop


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("unequal frames in a block of fixed lacing")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            n, w = read_vint(data, at)
            sizes.append(sizes[-1] + n - ((1 << 7 * w - 1) - 1) if k else n)
            at += w
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames beyond their block")
    return sizes, at


def _frame_ms(codec: str, entry: dict[int, bytes], audio: dict[int, bytes]) -> tuple[float, float]:
    """How long a frame of a track lasts, and each byte of it: by its default duration, by its samples' size for PCM, else not at all."""
    if duration := int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big"):
        return duration / 1e6, 0.0
    if not codec.startswith("A_PCM") or SAMPLING not in audio:
        return 0.0, 0.0
    rate = struct.unpack(">d" if len(audio[SAMPLING]) == 8 else ">f", audio[SAMPLING])[0]
    size = int.from_bytes(audio.get(CHANNELS, b"\x01"), "big") * int.from_bytes(audio.get(BIT_DEPTH, b""), "big") / 8
    return 0.0, 1000 / (rate * size) if rate and size else 0.0


def parse(data: bytes, out: Media | None = None) -> Media:
    """The packet table of a file. Broken files raise ValueError, IndexError or struct.error; `out` then has what comes before the fault."""
    out, lasting = Media() if out is None else out, {}
    for ident, _, at, end in elements(data, 0, len(data)):
        if ident == SEGMENT:
            for ident, start, a, b in elements(data, at, end):  # noqa: PLW2901
                if ident == INFO:
                    for i, _, x, y in elements(data, a, b):
                        if i == TIMESTAMP_SCALE:
                            out.scale_ns = int.from_bytes(data[x:y], "big")
                        elif i == DURATION:
                            out.duration_ms = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
                elif ident == TRACKS:
                    for i, _, x, y in elements(data, a, b):
                        if i == TRACK_ENTRY:
                            got = {k: data[p:q] for k, _, p, q in elements(data, x, y)}
                            number = int.from_bytes(got.get(TRACK_NUMBER, b""), "big")
                            out.tracks[number] = got.get(CODEC_ID, b"").decode("ascii", "replace")
                            audio = got.get(AUDIO, b"")
                            lasting[number] = _frame_ms(out.tracks[number], got, {k: audio[p:q] for k, _, p, q in elements(audio, 0, len(audio))})
                elif ident == CLUSTER:
                    out.clusters.append((start - at, b - a))
                    _cluster(data, a, b, out, lasting)
                elif ident == CUES:
                    for i, _, x, y in elements(data, a, b):
                        if i == CUE_POINT:
                            when, track, place = 0, 0, 0
                            for k, _, p, q in elements(data, x, y):
                                if k == CUE_TIME:
                                    when = int.from_bytes(data[p:q], "big")
                                elif k == CUE_POSITIONS:
                                    inner = {z: data[r:s] for z, _, r, s in elements(data, p, q)}
                                    track, place = int.from_bytes(inner.get(CUE_TRACK, b""), "big"), int.from_bytes(inner.get(CUE_CLUSTER, b""), "big")
                            out.cues.append((when, track, place))
    return out


def _cluster(data: bytes, at: int, end: int, out: Media, lasting: dict[int, tuple[float, float]]) -> None:
    base = 0
    for ident, _, a, b in elements(data, at, end):
        if ident == TIMESTAMP:
            base = int.from_bytes(data[a:b], "big")
            continue
        refers = None
        if ident == BLOCK_GROUP:
            inside = {i: (x, y) for i, _, x, y in elements(data, a, b)}
            if BLOCK not in inside:
                continue
            (a, b), refers = inside[BLOCK], REFERENCE_BLOCK in inside
        elif ident != SIMPLE_BLOCK:
            continue
        track, w = read_vint(data, a)
        relative, flags = struct.unpack_from(">hB", data, a + w)
        lacing = flags >> 1 & 3
        sizes, place = _lace_sizes(data, a + w + 3, b, lacing)
        # Frames of a lace follow each other; a block of a group is a key frame if it refers to no other.
        when, (frame, byte) = (base + relative) * out.scale_ns / 1e6, lasting.get(track, (0.0, 0.0))
        for n in sizes:
            out.packets.append((track, int(when), bool(flags & 0x80) if refers is None else not refers, lacing, place, n))
            place += n
            when += frame + n * byte


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: a positive multiple of FRAME, filled with spaces."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % FRAME if data else FRAME)


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join([data[at : at + n] for _, _, _, _, at, n in media.packets])


def feature(media: Media) -> str:
    kinds = [0, 0, 0, 0]
    for p in media.packets:
        kinds[p[3]] += 1
    placed = {at for at, _ in media.clusters}
    return (
        f"codec={media.tracks.get(1, '')};packets={len(media.packets)};clusters={len(media.clusters)};"
        f"cues={sum(place in placed for _, _, place in media.cues)};"
        + ";".join(f"{LACINGS[k]}={kinds[k]}" for k in range(4))
        + f";last_ms={media.packets[-1][1] if media.packets else 0};duration_ms={media.duration_ms:g}"
    )


PACKETS = "doc_id long, packet int, track int, timestamp_ms long, keyframe boolean, lacing string, byte_offset long, byte_size long, error string"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a Matroska file; a null text is the empty one."""

    def run(batches):
        for b in slices(batches, 512):
            made = [mux(padded(t)[1]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each packet of each file, with the kind of fault that ends the file (error), or null.

    A broken file has the packets before the fault, or one row without a packet. A null file
    and one without packets have no rows. Repeated rows give repeated results.
    """

    def run(batches):
        for b in slices(batches, 64):
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                media, error = Media(), None
                try:
                    parse(data or b"", media)
                except (ValueError, IndexError, struct.error) as e:
                    error = type(e).__name__
                rows += [(doc, k, p[0], p[1], p[2], LACINGS[p[3]], p[4], p[5], error) for k, p in enumerate(media.packets)]
                if error and not media.packets:
                    rows.append((doc, *[None] * 7, error))
            names = ["doc_id", "packet", "track", "timestamp_ms", "keyframe", "lacing", "byte_offset", "byte_size", "error"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names)

    return files.select(F.col(key).cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """A row for each document: its file written, read back and described (see DIGEST).

    Nulls: a null text is the empty one, 192 spaces; a null doc_id stays null.
    Repeated rows give repeated results; other columns are not looked at.
    """

    def run(batches):
        sha = hashlib.sha256
        for b in slices(batches, 512):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, payload = padded(text)
                data = mux(payload)
                media = parse(data)
                back = payload_of(data, media)
                rows.append((doc, n, len(back), sha(back).hexdigest(), zlib.crc32(back[-16:]), len(data), sha(data).hexdigest(), feature(media)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)


def op1_matroska(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
