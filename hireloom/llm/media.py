"""Media columns: ISO base media files (MP4/QuickTime), written and described.

`describe` walks the nested boxes of a file, decodes the sample tables of its
tracks and reports codec, duration and the byte ranges of the keyframes. It reads box
headers and tables only; sample payloads are never decoded.

`mux` stores bytes losslessly as a track of raw 8-bit grey frames of 8 x 8
samples, 64 bytes a frame, one chunk and one keyframe per `GOP` frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch

FRAME = 64
GOP = 16
TIMESCALE = 600
DELTA = 20
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *body: bytes) -> bytes:
    payload = b"".join(body)
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def full(kind: bytes, version: int, flags: int, *body: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def mux(payload: bytes, frame: int = FRAME, gop: int = GOP) -> bytes:
    """A QuickTime-brand file whose only track holds `payload`, a positive multiple of `frame` bytes."""
    frames = len(payload) // frame
    if not frames or frames * frame != len(payload):
        raise ValueError("the payload must be a positive multiple of the frame size")
    chunks = -(-frames // gop)
    rest = frames - (chunks - 1) * gop
    duration = frames * DELTA
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(
        b"raw ",
        struct.pack(">6xH", 1),
        struct.pack(">HH4sIIHHIIIH32sHh", 0, 0, b"\0" * 4, 0, 0, 8, 8, 72 << 16, 72 << 16, 0, 1, b"", 40, -1),
    )
    stsc = [(1, gop, 1)] if rest == gop or chunks == 1 else [(1, gop, 1), (chunks, rest, 1)]
    if chunks == 1:
        stsc = [(1, rest, 1)]

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * gop * frame).astype(">u4").tobytes()
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, frames, DELTA)),
            full(b"stsc", 0, 0, struct.pack(">I", len(stsc)), *[struct.pack(">III", *e) for e in stsc]),
            full(b"stsz", 0, 0, struct.pack(">II", frame, frames)),
            full(b"stss", 0, 0, struct.pack(">I", chunks), (1 + np.arange(chunks) * gop).astype(">u4").tobytes()),
            full(b"stco", 0, 0, struct.pack(">I", chunks), offsets),
        )
        dinf = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
        minf = box(b"minf", full(b"vmhd", 0, 1, b"\0" * 8), dinf, stbl)
        mdhd = full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0))
        hdlr = full(b"hdlr", 0, 0, struct.pack(">I4s12s", 0, b"vide", b""), b"\0")
        tkhd = full(b"tkhd", 0, 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, duration, 1 << 16, 1 << 8), matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + box(b"mdat", payload)


def walk(data, lo: int = 0, hi: int | None = None):
    """(kind, body start, body end) of the boxes in a range, 64-bit and to-the-end sizes included."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end < body or end > hi:
            raise ValueError(f"box {kind!r} reaches past its parent")
        yield kind, body, end
        lo = end


def find(data, path: tuple[bytes, ...], lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    found = [(lo, len(data) if hi is None else hi)]
    for kind in path:
        found = [(b, e) for lo_, hi_ in found for k, b, e in walk(data, lo_, hi_) if k == kind]
    return found


def _table(data, at: tuple[int, int], columns: int, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, at[0] + skip)[0]
    if at[0] + skip + 4 + 4 * n * columns > at[1]:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, ">u4", n * columns, at[0] + skip + 4).reshape(n, columns).astype(np.int64)


def _track(data, lo: int, hi: int) -> dict:
    mdia = find(data, (b"mdia",), lo, hi)[0]
    at = find(data, (b"mdhd",), *mdia)[0][0]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    handler = bytes(data[find(data, (b"hdlr",), *mdia)[0][0] + 8 :][:4]).decode("latin-1")
    stbl = find(data, (b"minf", b"stbl"), *mdia)[0]
    parts = {k: (b, e) for k, b, e in walk(data, *stbl)}
    codec = bytes(data[parts[b"stsd"][0] + 12 :][:4]).decode("latin-1")
    if b"stz2" in parts:
        at = parts[b"stz2"][0]
        field, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if field == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            sizes = np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
        else:
            sizes = np.frombuffer(data, f">u{field // 8}", n, at + 12).astype(np.int64)
    else:
        at = parts[b"stsz"][0]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    if b"co64" in parts:
        at = parts[b"co64"][0]
        starts = np.frombuffer(data, ">u8", struct.unpack_from(">I", data, at + 4)[0], at + 8).astype(np.int64)
    else:
        starts = _table(data, parts[b"stco"], 1)[:, 0]
    runs = _table(data, parts[b"stsc"], 3)
    per_chunk = np.zeros(len(starts), np.int64)
    for i, (first, count, _) in enumerate(runs.tolist()):
        per_chunk[first - 1 : runs[i + 1, 0] - 1 if i + 1 < len(runs) else None] = count
    if per_chunk.sum() < n:
        raise ValueError("chunks hold fewer samples than there are sizes")
    chunk = np.repeat(np.arange(len(starts)), per_chunk)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(starts)))
    base = before[np.minimum(first, max(n - 1, 0))] if n else before
    offsets = starts[chunk] + before - (base[chunk] if n else 0)
    stts = _table(data, parts[b"stts"], 2)
    keys = _table(data, parts[b"stss"], 1)[:, 0] - 1 if b"stss" in parts else np.arange(n)  # without the table every sample is one
    keys = keys[(keys >= 0) & (keys < n)]
    return {
        "handler": handler, "codec": codec, "timescale": int(timescale), "duration": int(duration), "samples": int(n),
        "ticks": int((stts[:, 0] * stts[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys,
    }


def describe(data: bytes) -> list[dict]:
    """The tracks of a file; raises ValueError for bytes that aren't a whole ISO media file."""
    try:
        tracks = find(data, (b"moov", b"trak"))
        if not tracks:
            raise ValueError("no track")
        return [_track(data, *t) for t in tracks]
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"not a whole ISO media file: {e}") from e


def samples(data: bytes, track: dict) -> bytes:
    """The bytes of all samples of a track in order, as they are stored."""
    offsets, sizes = track["offsets"], track["sizes"]
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1  # contiguous samples are one slice
    ends = (offsets + sizes)[np.append(cuts - 1, len(offsets) - 1)] if len(offsets) else []
    starts = offsets[np.concatenate(([0], cuts)).astype(int)] if len(offsets) else []
    return b"".join(data[int(a) : int(b)] for a, b in zip(starts, ends))


def feature(track: dict) -> str:
    ranges = ",".join(f"{track['offsets'][k]}+{track['sizes'][k]}" for k in track["keys"].tolist())
    return f"codec={track['codec'].strip()};duration={track['duration']}/{track['timescale']};samples={track['samples']};keyframes={ranges}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches):
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
        media = [mux(t + b"\0" * (-len(t) % FRAME or (0 if t else FRAME))) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
        )


def _read_back(batches):
    for batch in batches:
        rows = []
        for value in batch.column(2):
            data = value.as_py()
            track = describe(data)[0]
            payload = samples(data, track)
            rows.append(
                (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature(track),
                )
            )
        if rows:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text of each document as an ISO media file.

    Null text counts as empty. The payload is the UTF-8 text and zero bytes up
    to a positive multiple of 64.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_store, MEDIA_SCHEMA)


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text as a media file in the shared folder, read the files back and describe them.

    One row per row of `docs`, repeats and null ids included; equal texts give
    equal values; an empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(spark, "media")
    return scratch.keep(store_media(docs), "media").mapInArrow(_read_back, RESULT_SCHEMA)


TRACK_TYPE = "struct<handler:string,codec:string,seconds:double,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>"


def describe_media(files: DataFrame, column: str = "media") -> DataFrame:
    """Any table with a binary column of ISO media files: its rows with `tracks` and `media_error` added.

    Null, empty or broken files give null tracks and a message; columns of
    those two names are replaced.
    """
    @F.pandas_udf(f"tracks array<{TRACK_TYPE}>, media_error string")
    def look(media: pd.Series) -> pd.DataFrame:
        rows = []
        for data in media:
            try:
                found = describe(bytes(data) if data is not None else b"")
                rows.append(
                    ([
                        {
                            "handler": t["handler"], "codec": t["codec"].strip(), "seconds": t["duration"] / max(1, t["timescale"]), "samples": t["samples"],
                            "keyframes": [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"]],
                        }
                        for t in found
                    ], None)
                )
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["tracks", "media_error"])

    seen = files.withColumn("__seen", look(F.col(column)))
    return seen.withColumn("tracks", F.col("__seen.tracks")).withColumn("media_error", F.col("__seen.media_error")).drop("__seen")
