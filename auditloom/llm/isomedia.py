"""ISO media containers as a binary column: a writer and a walker that never decodes payloads.

The writer puts a payload into a movie with one raw track: each sample is 64 bytes (8 x 8
eight-bit values), samples lie in chunks, and every ``keyframe_interval``-th sample is listed as
a sync sample. The walker follows nested boxes of any such container (32-bit, 64-bit and
to-the-end sizes), reads the sample tables and gives codec, duration and the byte ranges of the
sync samples.

Limits: of sample sizes only ``stsz`` is read. Files with ``stz2``, or fragmented ones (``trun``),
give no samples or keyframes. Features are of the first video track; a file without any looks
malformed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm._common import doc_columns, shared_path, slices, small_batches

SAMPLE_BYTES = 64
SAMPLES_PER_CHUNK = 1024
KEYFRAME_INTERVAL = 32
TIMESCALE = 25
#: Boxes that hold boxes, with the bytes of their own fields before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"moof": 0, b"traf": 0, b"udta": 0}
#: Nesting beyond which a container counts as malformed.
MOST_DEPTH = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, keyframe_interval: int = KEYFRAME_INTERVAL) -> bytes:
    """A movie whose media data is ``payload`` (a multiple of 64 bytes); equal payloads give equal bytes."""
    samples = len(payload) // SAMPLE_BYTES
    chunks = -(-samples // SAMPLES_PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    keys = np.arange(1, samples + 1, keyframe_interval, dtype=">u4")
    last = samples - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] * (chunks > 1 or last == SAMPLES_PER_CHUNK) + [(chunks, last, 1)] * (last != SAMPLES_PER_CHUNK)

    def movie(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = first + np.arange(chunks, dtype=np.uint64) * np.uint64(SAMPLES_PER_CHUNK * SAMPLE_BYTES)
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, samples, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">2I", SAMPLE_BYTES, samples)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, samples, 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"raw\0"),
            box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
        )
        head = full_box(b"mvhd", struct.pack(">4I", 0, 0, TIMESCALE, samples), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        track = full_box(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, samples), bytes(8), struct.pack(">4H", 0, 0, 0, 0), matrix, struct.pack(">2I", 8 << 16, 8 << 16), flags=3)
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41") + box(b"moov", head, box(b"trak", track, media))

    extra = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(movie(0)) if len(payload) < 1 << 31 else len(movie(1 << 32))
    return movie(size + extra) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  #: of each sample
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  #: sample numbers from 0

    def keyframe_ranges(self) -> np.ndarray:
        """(begin, end) of each sync sample in the file."""
        begin = self.offsets[self.keyframes]
        return np.stack([begin, begin + self.sizes[self.keyframes]], axis=1)


def walk(data: memoryview, begin: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box kinds, begin and end of the body) of every box, parents first."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} at {begin} runs over its parent")
        here = (*path, kind)
        yield here, begin + head, begin + size
        if kind in CONTAINERS and len(here) <= MOST_DEPTH:
            yield from walk(data, begin + head + CONTAINERS[kind], begin + size, here)
        begin += size


def _table(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    if n * width * np.dtype(kind).itemsize > end - at - 8:
        raise ValueError("a sample table runs over its box")
    return np.frombuffer(data, dtype=kind, count=n * width, offset=at + 8).astype(np.int64).reshape((-1, width) if width > 1 else -1)


def read_tracks(container: bytes) -> list[Track]:
    """The tracks of a container. Raises ValueError if boxes or tables are malformed."""
    data = memoryview(container)
    tables: list[dict] = []
    for path, at, end in walk(data):
        if path[-1] == b"trak":
            tables.append({})
        elif tables and b"trak" in path:
            tables[-1][path[-1]] = (at, end)
    return [_track(data, t) for t in tables]


def _track(data: memoryview, boxes: dict) -> Track:
    track = Track()
    try:
        if at := boxes.get(b"mdhd", (None,))[0]:
            long = data[at] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if long else struct.unpack_from(">II", data, at + 12)
        if at := boxes.get(b"hdlr", (None,))[0]:
            track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        if at := boxes.get(b"stsd", (None,))[0]:
            track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        if b"stsz" in boxes:
            at, end = boxes[b"stsz"]
            one, n = struct.unpack_from(">II", data, at + 4)
            if not one and 4 * n > end - at - 12:
                raise ValueError("a sample table runs over its box")
            track.sizes = np.full(n, one, dtype=np.int64) if one else np.frombuffer(data, dtype=">u4", count=n, offset=at + 12).astype(np.int64)
        chunks = _table(data, *boxes[b"co64"], ">u8") if b"co64" in boxes else _table(data, *boxes[b"stco"], ">u4") if b"stco" in boxes else np.zeros(0, dtype=np.int64)
        if b"stsc" in boxes and len(chunks):
            runs = _table(data, *boxes[b"stsc"], ">u4", 3)
            last = np.append(runs[1:, 0], len(chunks) + 1)
            held = np.repeat(runs[:, 1], last - runs[:, 0])  # samples in each chunk
            chunk = np.repeat(np.arange(len(held)), held)[: len(track.sizes)]
            if len(chunk) < len(track.sizes):
                raise ValueError("chunks hold fewer samples than there are sizes")
            before = np.concatenate([[0], np.cumsum(track.sizes)])[:-1]
            first = np.concatenate([[0], np.cumsum(held)])[:-1]
            track.offsets = chunks[chunk] + before - before[np.minimum(first, len(before) - 1)][chunk] if len(before) else before
        track.keyframes = _table(data, *boxes[b"stss"], ">u4") - 1 if b"stss" in boxes else np.arange(len(track.sizes))
        if len(track.keyframes) and (track.keyframes.min() < 0 or track.keyframes.max() >= min(len(track.sizes), len(track.offsets))):
            raise ValueError("a sync sample is not in the track")
    except (struct.error, IndexError) as e:
        raise ValueError(f"malformed table: {e}") from e
    return track


def media_payload(container: bytes, track: Track) -> bytes:
    """The stored bytes of all samples in order, as the sample tables place them."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    begins, stops = track.offsets[np.r_[0, cuts]], ends[np.r_[cuts - 1, len(ends) - 1]]
    return b"".join(container[a:b] for a, b in zip(begins, stops, strict=True))


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % SAMPLE_BYTES or (0 if text else SAMPLE_BYTES))


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<long>"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text, as UTF-8 filled up to 64 bytes, in a container."""
    small_batches(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = [write_container(payload_of(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(write, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Codec, duration and keyframe byte ranges of a media column, with digests of what is stored.

    A null or malformed container gets a null codec and empty digests instead of an error.
    """
    small_batches(media.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = [features_of(d, n, m) for d, n, m in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def features_of(doc: int | None, n_bytes: int | None, container: bytes | None) -> tuple:
    try:
        track = next((t for t in read_tracks(container or b"") if t.handler == "vide"), None)
    except ValueError:
        track = None
    stored = hashlib.sha256(container or b"").hexdigest()
    if track is None:
        return doc, n_bytes, 0, None, None, len(container or b""), stored, None, None, None, None
    payload = media_payload(container, track)
    ranges = track.keyframe_ranges().reshape(-1)
    seconds = track.duration / track.timescale if track.timescale else 0.0
    feature = f"codec={track.codec.strip()};seconds={seconds:.2f};samples={len(track.sizes)};keyframes={len(ranges) // 2};ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    return doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE_BYTES:]), len(container), stored, feature, track.codec, seconds, ranges.tolist()


def media_table(docs: DataFrame) -> DataFrame:
    """Store all texts as media in the shared folder, read them back and compute their features.

    One row for each row of ``docs``; null texts count as empty (64 zero bytes); an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "media")
    media_column(docs).write.option("compression", "zstd").parquet(path)
    return media_features(spark.read.schema(MEDIA).parquet(path))
