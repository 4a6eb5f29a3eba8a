"""Media columns: ISO media containers in a binary column, indexed without decoding what they hold.

The reader walks the nested boxes, decodes the sample tables (stsd, stts, stsz, stsc, stco or co64, stss) and gives
codec, duration and the byte ranges of keyframes. The writer stores bytes losslessly as uncompressed 8-bit samples: video
of 8 x 8 grey frames of 64 bytes each. Its output depends on nothing but the payload, so equal payloads have equal files.

The index columns are those of the first video track, or of the first track where there is none; `index` also lists all
tracks. Duration is the sum of the track's sample durations. Times, counts and places that a file states are checked
against its size before anything is made from them: boxes nested more than 32 deep, a track with more samples than the
file has bytes, or tables that do not agree are broken media, not a task's failure.

A null payload is the empty one; a null or broken container gives nulls in every column that is read from it. Equal and
repeated payloads are stored each by itself. No rows in give no rows out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, tidied

# Names of boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}
FRAME, SIDE, RATE, KEY_EVERY, PER_CHUNK = 64, 8, 25, 25, 256
DEEPEST = 32
# Fixed value: the unity matrix of a header.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class BrokenMedia(ValueError):
    """The bytes are no readable ISO media container."""


def box(name: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I", len(body) + 8) + name + body


def full(name: bytes, flags: int, *content: bytes) -> bytes:
    return box(name, struct.pack(">I", flags), *content)


def words(values: np.ndarray, wide: bool = False) -> bytes:
    return values.astype(">u8" if wide else ">u4").tobytes()


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of a frame."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
STSD = full(
    b"stsd", 0, struct.pack(">I", 1),
    box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)),
)
FIXED = full(b"vmhd", 1, bytes(8)) + box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1)))
HDLR = full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0")


def pack(payload: bytes) -> bytes:
    """A container with the payload, a positive multiple of 64 bytes, as its frames; the index comes first."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    rest = frames - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1 or rest == PER_CHUNK) + [(chunks, rest, 1)] * (rest != PER_CHUNK)
    wide = len(payload) > 0xFFFF0000
    keys = np.arange(1, frames + 1, KEY_EVERY)
    tkhd = full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
    mvhd = full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    mdhd = full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0))
    tables = (
        STSD
        + full(b"stts", 0, struct.pack(">III", 1, frames, 1))
        + full(b"stss", 0, struct.pack(">I", len(keys)), words(keys))
        + full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
        + full(b"stsz", 0, struct.pack(">II", FRAME, frames))
    )

    def index(first: int) -> bytes:
        places = np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME) + first
        offsets = full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), words(places, wide))
        media = box(b"mdia", mdhd, HDLR, box(b"minf", FIXED, box(b"stbl", tables, offsets)))
        return box(b"moov", mvhd, box(b"trak", tkhd, media))

    start = len(FTYP) + len(index(0)) + (16 if wide else 8)
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((FTYP, index(start), head, payload))


def walk(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, start and end of the content) of the boxes side by side; contents aren't looked at."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, name = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > stop:
                raise BrokenMedia("a box ends in its header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        end = stop if size == 0 else start + size
        if end > stop or end < start + head:
            raise BrokenMedia(f"box {name!r} goes beyond its container")
        yield name, start + head, end
        start = end


def tree(data: bytes, start: int = 0, stop: int | None = None, depth: int = 0) -> dict[bytes, list]:
    """Boxes by name; of containers their own tree, of others their place. Each name lists all its boxes."""
    if depth > DEEPEST:
        raise BrokenMedia("boxes are nested too deep")
    out: dict[bytes, list] = {}
    for name, a, b in walk(data, start, stop):
        out.setdefault(name, []).append(tree(data, a, b, depth + 1) if name in CONTAINERS else (a, b))
    return out


@dataclass
class Track:
    handler: str
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    sizes: np.ndarray = field(repr=False)
    offsets: np.ndarray = field(repr=False)
    keyframes: np.ndarray = field(repr=False)  # from 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    @property
    def key_ranges(self) -> np.ndarray:
        """(n, 2): offset and length."""
        return np.stack([self.offsets[self.keyframes], self.sizes[self.keyframes]], axis=1)


def _table(data: bytes, place: tuple[int, int], skip: int, dtype: str, count: int, width: int = 1) -> np.ndarray:
    a, b = place
    need = np.dtype(dtype).itemsize * count * width
    if a + skip + need > b:
        raise BrokenMedia("a sample table ends early")
    return np.frombuffer(data, dtype, count * width, a + skip).astype(np.int64)


def _number(data: bytes, place: tuple[int, int], at: int) -> int:
    return struct.unpack_from(">I", data, place[0] + at)[0]


def track(data: bytes, trak: dict[bytes, list]) -> Track:
    mdia = trak[b"mdia"][0]
    stbl = mdia[b"minf"][0][b"stbl"][0]
    mdhd = mdia[b"mdhd"][0]
    wide = data[mdhd[0]] == 1
    timescale = _number(data, mdhd, 20 if wide else 12)
    duration = struct.unpack_from(">Q" if wide else ">I", data, mdhd[0] + (24 if wide else 16))[0]
    handler = data[mdia[b"hdlr"][0][0] + 8 :][:4].decode("latin-1")
    entry = stbl[b"stsd"][0][0] + 8
    codec = data[entry + 4 : entry + 8].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, entry + 32) if handler == "vide" else (0, 0)
    stsz = stbl[b"stsz"][0]
    same, n = _number(data, stsz, 4), _number(data, stsz, 8)
    if n > len(data):
        raise BrokenMedia("more samples than bytes")
    times = stbl[b"stts"][0]
    lasts = _table(data, times, 8, ">u4", _number(data, times, 4), 2).reshape(-1, 2)
    if int(lasts[:, 0].sum()) != n:
        raise BrokenMedia("sample times and samples don't agree")
    duration = int((lasts[:, 0] * lasts[:, 1]).sum()) or duration
    sizes = np.full(n, same, np.int64) if same else _table(data, stsz, 12, ">u4", n)
    chunk_box, kind = (stbl[b"stco"][0], ">u4") if b"stco" in stbl else (stbl[b"co64"][0], ">u8")
    chunks = _table(data, chunk_box, 8, kind, _number(data, chunk_box, 4))
    stsc = stbl[b"stsc"][0]
    runs = _table(data, stsc, 8, ">u4", _number(data, stsc, 4), 3).reshape(-1, 3)
    spans = np.diff(np.r_[runs[:, 0] - 1, len(chunks)])
    if (spans < 0).any() or int(spans.sum()) != len(chunks):
        raise BrokenMedia("runs of chunks and chunks don't agree")
    per_chunk = np.repeat(runs[:, 1], spans)
    if int(per_chunk.sum()) != n:
        raise BrokenMedia("chunks and samples don't agree")
    # a sample begins where its chunk does, plus the samples of the chunk before it
    before = np.cumsum(sizes) - sizes
    heads = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(chunks - before[heads], per_chunk) + before if n else before
    keys = np.arange(n)
    if b"stss" in stbl:
        keys = _table(data, stbl[b"stss"][0], 8, ">u4", _number(data, stbl[b"stss"][0], 4)) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise BrokenMedia("a keyframe is no sample")
    return Track(handler, codec, width, height, timescale, duration, sizes, offsets, keys)


def read(data: bytes) -> list[Track]:
    """The tracks. Bytes that are no such container raise BrokenMedia."""
    try:
        boxes = tree(data)
        return [track(data, trak) for trak in boxes[b"moov"][0].get(b"trak", [])]
    except (KeyError, IndexError, AttributeError, TypeError, struct.error, ValueError, OverflowError) as e:
        raise BrokenMedia(str(e)) from e


def samples(data: bytes, t: Track) -> bytes:
    """The samples' bytes in order; neighbours are read together."""
    if not len(t.sizes):
        return b""
    ends = t.offsets + t.sizes
    cut = np.flatnonzero(t.offsets[1:] != ends[:-1]) + 1
    if int(ends.max()) > len(data):
        raise BrokenMedia("a sample goes beyond the file")
    return b"".join(data[a:b] for a, b in zip(t.offsets[np.r_[0, cut]], ends[np.r_[cut - 1, len(ends) - 1]], strict=True))


RANGE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
INDEX = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(RANGE)),
    ]
)
TRACKS = T.StructField("tracks", T.ArrayType(T.StructType([T.StructField("handler", T.StringType()), *INDEX.fields])))
ARROW = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
ARROW_TRACKS = pa.list_(
    pa.struct([("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", ARROW)])
)


def tracks_of(data: bytes | None) -> list[Track]:
    """All tracks; none of a null or broken container."""
    try:
        return read(data) if data is not None else []
    except BrokenMedia:
        return []


def main_track(tracks: Sequence[Track]) -> Track | None:
    return next((t for t in tracks if t.handler == "vide"), tracks[0] if tracks else None)


def index_columns(tracks: Sequence[Track | None]) -> list[pa.Array]:
    """The columns of INDEX."""
    pick = lambda f, kind: pa.array([None if t is None else f(t) for t in tracks], kind)
    ranges = [t.key_ranges if t else np.zeros((0, 2), np.int64) for t in tracks]
    flat = np.concatenate(ranges) if ranges else np.zeros((0, 2), np.int64)
    ends = np.r_[0, np.cumsum([len(r) for r in ranges])].astype(np.int32)
    keys = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["offset", "length"]))
    if None in tracks:
        keys = pa.compute.if_else(pa.array([t is not None for t in tracks]), keys, pa.scalar(None, ARROW))
    return [
        pick(lambda t: t.codec, pa.string()), pick(lambda t: t.width, pa.int32()), pick(lambda t: t.height, pa.int32()),
        pick(lambda t: t.seconds, pa.float64()), pick(lambda t: len(t.sizes), pa.int64()), keys,
    ]


def _listed(tracks: Sequence[Track]) -> list[dict] | None:
    if not tracks:
        return None
    ranges = lambda t: [{"offset": a, "length": b} for a, b in t.key_ranges.tolist()]
    return [{"handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "duration": t.seconds, "n_samples": len(t.sizes), "keyframes": ranges(t)} for t in tracks]


def _pieces(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _schema(df: DataFrame, kept: Sequence[str], new: Sequence[T.StructField]) -> tuple[list[str], T.StructType]:
    """Columns to keep, without those that an output replaces, and the result's schema."""
    kept = [c for c in kept if c not in {f.name for f in new}]
    return kept, T.StructType([*(df.schema[c] for c in kept), *new])


def _select(df: DataFrame, first: str, kept: Sequence[str]) -> DataFrame:
    return df.select(F.col(f"`{first}`"), *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(kept)))


def store(df: DataFrame, payload: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """df with a column media: each payload, string or binary, padded to whole frames and packed; the index columns; and
    payload, the bytes read back from the container through its sample tables. keep: columns of df to return, all by
    default; one that has an output's name is replaced. One pass, no shuffle; a row in gives a row out."""
    new = [T.StructField("media", T.BinaryType()), *INDEX.fields, T.StructField("payload", T.BinaryType())]
    kept, schema = _schema(df, df.columns if keep is None else keep, new)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _pieces(batch):
                media = [pack(padded(v or b"")) for v in own.column(0).cast(pa.binary()).to_pylist()]
                tracks = [read(m)[0] for m in media]
                back = pa.array([samples(m, t) for m, t in zip(media, tracks, strict=True)], pa.binary())
                arrays = [*own.columns[1:], pa.array(media, pa.binary()), *index_columns(tracks), back]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return _select(df, payload, kept).mapInArrow(tidied(run), schema)


def index(df: DataFrame, media: str = "media", keep: Sequence[str] | None = None) -> DataFrame:
    """df with the columns of INDEX for containers that it already holds, and `tracks`, the same of every track."""
    kept, schema = _schema(df, df.columns if keep is None else keep, [*INDEX.fields, TRACKS])
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _pieces(batch):
                tracks = [tracks_of(data) for data in own.column(0).to_pylist()]
                listed = pa.array([_listed(t) for t in tracks], ARROW_TRACKS)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], *index_columns([main_track(t) for t in tracks]), listed], schema.names)

    return _select(df, media, kept).mapInArrow(tidied(run), schema)
