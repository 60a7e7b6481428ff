"""Media columns: ISO base media containers (MP4 and kin) read by their boxes.

`probe` walks the nested boxes of a file, decodes the sample tables of its first
track (stsd, stts, stsz, stsc, stco or co64, stss), and gives codec, duration and
the byte range of every keyframe. It never decodes a payload: keyframe ranges
are enough to fetch or cut the media later.

`mux` stores bytes losslessly as 8-bit samples: frames of 8 x 8 grey pixels (64
bytes), one frame a sample, in chunks of 64 frames, with every sixteenth a keyframe.

Defined results: null media or bytes that are no container give null fields and a
reason in `error`; a box that claims more bytes than there are ends the walk with
`truncated box`; sample tables that point outside the file are reported. Null text is empty
(one frame of zero bytes); equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_bytes, keyed_text, read, texts_of

FRAME = 64
FRAMES_A_SECOND = 25
FRAMES_A_CHUNK = 64
KEYFRAME_EVERY = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of the frame size."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def mux(payload: bytes) -> bytes:
    """A file whose media data is `payload`, a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_A_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    wide = len(payload) + 8 >= 1 << 32
    mdat = (struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")) + payload
    start = len(ftyp) + (16 if wide else 8)
    offsets = start + FRAME * FRAMES_A_CHUNK * np.arange(chunks, dtype=np.int64)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    last = n - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK, 1)] if chunks > 1 and last == FRAMES_A_CHUNK else [(1, FRAMES_A_CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    keys = np.arange(1, n + 1, KEYFRAME_EVERY)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    times = struct.pack(">IIII", 0, 0, FRAMES_A_SECOND, n)
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
    mvhd = full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


class BadMedia(ValueError):
    pass


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, from, to) of the boxes of a range; the body only."""
    at = start
    while at < end:
        if end - at < 8:
            raise BadMedia("truncated box")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise BadMedia("truncated box")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise BadMedia("truncated box")
        yield kind, at + head, at + size
        at += size


def tree(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box with its path, depth first; nesting is bounded."""
    if len(path) > 16:
        raise BadMedia("boxes nested too deep")
    for kind, a, b in walk(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from tree(data, a, b, (*path, kind))


def table(data: memoryview, a: int, b: int, skip: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a counted table inside a full box."""
    if b - a < skip + 4:
        raise BadMedia("truncated table")
    (n,) = struct.unpack_from(">I", data, a + skip)
    width = np.dtype(kind).itemsize * columns
    if n * width > b - a - skip - 4:
        raise BadMedia("truncated table")
    return np.frombuffer(data, kind, n * columns, a + skip + 4).astype(np.int64).reshape(n, columns)


STBL = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def probe(media: bytes | None) -> dict:
    """brand, codec, timescale, duration, n_samples, sample_offset, sample_size, keyframes (arrays) or an error."""
    out = {"error": None}
    try:
        if media is None:
            raise BadMedia("no media")
        data = memoryview(media)
        boxes: dict[tuple[bytes, ...], tuple[int, int]] = {}
        for path, a, b in tree(data, 0, len(data)):
            boxes.setdefault(path, (a, b))  # the first track
        if (b"ftyp",) not in boxes and (b"moov",) not in boxes:
            raise BadMedia("no container")

        def need(*path: bytes) -> tuple[int, int]:
            if path not in boxes:
                raise BadMedia(f"no {path[-1].decode('latin-1').strip()} box")
            return boxes[path]

        if (b"ftyp",) in boxes:
            a, b = boxes[b"ftyp",]
            out["brand"] = bytes(data[a : min(b, a + 4)]).decode("latin-1").strip()
        a, b = need(*STBL[:3], b"mdhd")
        wide = data[a] == 1 if b > a else False
        if b - a < (32 if wide else 20):
            raise BadMedia("truncated mdhd box")
        out["timescale"], out["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        a, b = need(*STBL, b"stsd")
        if b - a < 16:
            raise BadMedia("truncated stsd box")
        out["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
        a, b = need(*STBL, b"stsz")
        if b - a < 12:
            raise BadMedia("truncated stsz box")
        same, n = struct.unpack_from(">II", data, a + 4)
        if same:
            if same * n > len(data):
                raise BadMedia("samples outside the file")
            sizes = np.full(n, same, np.int64)
        else:
            sizes = table(data, a, b, 8, 1)[:, 0]
        runs = table(data, *need(*STBL, b"stsc"), 4, 3)
        chunks = table(data, *boxes[*STBL, b"co64"], 4, 1, ">u8")[:, 0] if (*STBL, b"co64") in boxes else table(data, *need(*STBL, b"stco"), 4, 1)[:, 0]
        times = table(data, *need(*STBL, b"stts"), 4, 2)
        if int(times[:, 0].sum()) != len(sizes):
            raise BadMedia("sample times and sizes differ in number")
        # Samples of each chunk, from runs of chunks of a like number.
        first = np.append(runs[:, 0] - 1, len(chunks))
        if len(runs) and (first[0] != 0 or (np.diff(first) < 0).any()):
            raise BadMedia("bad chunk runs")
        each = np.repeat(runs[:, 1], np.diff(first)) if len(runs) else np.zeros(0, np.int64)
        if int(each.sum()) != len(sizes):
            raise BadMedia("chunks and sizes differ in number of samples")
        before = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(each)), each)
        start = np.cumsum(each) - each
        offsets = chunks[owner] + before - before[start[owner]] if len(sizes) else np.zeros(0, np.int64)
        if len(sizes) and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
            raise BadMedia("samples outside the file")
        keys = table(data, *boxes[*STBL, b"stss"], 4, 1)[:, 0] - 1 if (*STBL, b"stss") in boxes else np.arange(len(sizes))
        if len(keys) and (int(keys.max()) >= len(sizes) or int(keys.min()) < 0):
            raise BadMedia("keyframes outside the samples")
        out |= {"n_samples": len(sizes), "sample_offset": offsets, "sample_size": sizes, "keyframes": keys, "decode_time": int((times[:, 0] * times[:, 1]).sum())}
    except BadMedia as e:
        out = {"error": str(e)}
    return out


def stored_bytes(media: bytes, found: dict) -> bytes:
    """The samples' bytes in order, as the sample tables place them."""
    offsets, sizes = found["sample_offset"], found["sample_size"]
    if not len(offsets):
        return b""
    joined = offsets[1:] != offsets[:-1] + sizes[:-1]
    starts = np.flatnonzero(np.append(True, joined))
    ends = np.append(starts[1:], len(offsets)) - 1
    return b"".join(media[offsets[s] : offsets[e] + sizes[e]] for s, e in zip(starts, ends, strict=True))


FIELDS = "brand string, codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,length:long>>, error string"


def media_columns(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id and what `probe` finds; keyframe ranges as (offset, length) in the stored file."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in by_bytes(batches, "media", 32 << 20):
            rows = []
            for x in batch.column("media").to_pylist():
                p = probe(x)
                keys = p.get("keyframes")
                rows.append(
                    {
                        "brand": p.get("brand"), "codec": p.get("codec"), "n_samples": p.get("n_samples"), "error": p["error"],
                        "duration_s": p["duration"] / p["timescale"] if p.get("timescale") else None,
                        "keyframes": None if keys is None else [{"offset": o, "length": s} for o, s in zip(p["sample_offset"][keys].tolist(), p["sample_size"][keys].tolist(), strict=True)],
                    }
                )
            columns = {c: [r[c] for r in rows] for c in ("brand", "codec", "duration_s", "n_samples", "keyframes", "error")}
            types = [pa.string(), pa.string(), pa.float64(), pa.int64(), kind, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, t) for v, t in zip(columns.values(), types, strict=True))], names=["id", *columns])

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(probed, f"id long, {FIELDS}").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the container of every text."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"]
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(stored, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text goes to a container and back within one task, so that no file crosses a shuffle."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            out = []
            for text in texts_of(batch):
                media = mux(padded(text))
                p = probe(media)
                if p["error"]:
                    raise BadMedia(p["error"])
                back = stored_bytes(media, p)
                keys = p["keyframes"]
                at, sizes = p["sample_offset"][keys], p["sample_size"][keys]
                feature = (
                    f"brand={p['brand']};codec={p['codec']};duration={p['duration']}/{p['timescale']};samples={p['n_samples']};"
                    f"keyframes={len(keys)};first={at[0]}+{sizes[0]};last={at[-1]}+{sizes[-1]};mean={np.frombuffer(back, np.uint8).mean():.6f}"
                )
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return keyed_text(read(spark, sf_dir, "documents"), "doc_id", "text").mapInArrow(
        digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
