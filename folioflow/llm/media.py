"""PNG images in binary columns: chunks with checksums, unfiltering in numpy, hashes of low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import stored, text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type, at 8 bits a sample.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: A payload's row: 64 pixels of three samples.
WIDTH, ROW = 64, 192
#: Most bytes of one IDAT chunk.
IDAT = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """rows (height x bytes) filtered by the PNG filter kinds given for each, with the kind in front."""
    out = np.concatenate([kinds.astype(np.uint8)[:, None], rows], axis=1)
    for kind in np.unique(kinds).tolist():
        of = np.flatnonzero(kinds == kind)
        x, up = rows[of], rows[of - 1] * (of > 0)[:, None].astype(np.uint8)
        left, corner = np.zeros_like(x), np.zeros_like(x)
        left[:, bpp:], corner[:, bpp:] = x[:, :-bpp], up[:, :-bpp]
        wide = lambda v: v.astype(np.int16)
        before = [lambda: 0, lambda: left, lambda: up, lambda: (wide(left) + up) >> 1, lambda: _paeth(wide(left), wide(up), wide(corner))][kind]()
        out[of, 1:] = x - np.asarray(before).astype(np.uint8)
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(filtered: np.ndarray, bpp: int) -> np.ndarray:
    """The rows of a PNG's data (height x (1 + bytes)): all rows of kind 1 at once, then runs of kind 2, and kinds 3 and 4 pixel by pixel."""
    kinds, out = filtered[:, 0], filtered[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if (sub := kinds == 1).any():
        pixels = out[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(len(pixels), -1)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(out)], strict=True):
        kind = kinds[start]
        if kind == 2:
            if start:
                out[start] += out[start - 1]
            if stop - start > 1:
                np.cumsum(out[start:stop], axis=0, dtype=np.uint8, out=out[start:stop])
        elif kind > 2:
            for k in range(start, stop):
                up = out[k - 1].astype(np.int16) if k else np.zeros(out.shape[1], np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for x in range(0, out.shape[1], bpp):
                    b = up[x : x + bpp]
                    out[k, x : x + bpp] += ((left + b) >> 1 if kind == 3 else _paeth(left, b, corner)).astype(np.uint8)
                    left, corner = out[k, x : x + bpp].astype(np.int16), b
    return out


def least_kinds(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Of each row the kind of 0, 1 and 2 that leaves the least sum of differences, taken as signed bytes; the first of equals."""
    left, above = rows.copy(), rows.copy()
    left[:, bpp:] -= rows[:, :-bpp]
    above[1:] -= rows[:-1]
    sums = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (rows, left, above)]
    return np.argmin(sums, axis=0)


def encode_png(samples: bytes, width: int, colour: int = 2, kinds: np.ndarray | None = None, level: int = 6) -> bytes:
    """A PNG of 8-bit samples; kinds: the filter of each row, if not given that of least_kinds."""
    bpp = CHANNELS[colour]
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width * bpp)
    filtered = filter_rows(rows, least_kinds(rows, bpp) if kinds is None else kinds, bpp)
    data = zlib.compress(filtered.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[k : k + IDAT]) for k in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG without interlace; wrong checksums, lengths or kinds are errors."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, unzip, parts, last = 8, b"", zlib.decompressobj(), [], b""
    while last != b"IEND":
        if at + 12 > len(png):
            raise ValueError("the PNG ends early")
        (n,), last = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(data) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(last))):
            raise ValueError(f"checksum of chunk {last!r} differs")
        if last == b"IHDR":
            head = data
        elif last == b"IDAT":
            parts.append(unzip.decompress(data))
        at += 12 + n
    if len(head) != 13 or not unzip.eof or at != len(png):
        raise ValueError("the PNG's header or data isn't whole")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only 8-bit PNG without palette and interlace")
    bpp = CHANNELS[colour]
    filtered = np.frombuffer(b"".join(parts), np.uint8)
    if len(filtered) != height * (1 + width * bpp):
        raise ValueError("the PNG's data has another size than its header says")
    return unfilter(filtered.reshape(height, -1), bpp).reshape(height, width, bpp)


def _cosines(n: int, low: int) -> np.ndarray:
    """The lowest frequencies of the cosine transform (type II) over n samples."""
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


_DCT = _cosines(32, 8)


def _shrunk(image: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means over side parts of an axis; where it is shorter, its samples repeat."""
    n = image.shape[axis]
    if n < side:
        return np.take(image, np.arange(side) * n // side, axis)
    edges = np.arange(side + 1) * n // side
    sizes = np.diff(edges).reshape([-1, 1] if axis == 0 else [1, -1])
    return np.add.reduceat(image, edges[:-1], axis) / sizes


def cosine_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: of the 64 lowest frequencies of the grey 32 x 32 image, whether each is above their median (the first, the mean, is left out of that)."""
    grey = pixels.sum(axis=2, dtype=np.float64) / pixels.shape[2]
    low = np.round(_DCT @ _shrunk(_shrunk(grey, 32, 0), 32, 1) @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store_text_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text (null: empty) padded with blanks to rows of 192 bytes, as a PNG in a stored binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                sizes.append(len(data))
                media.append(encode_png(data + b" " * (-len(data) % ROW if data else ROW), WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return stored(rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "media", "none")


def media_features(media: DataFrame) -> DataFrame:
    """Read (doc_id, n_bytes, media) back: the payload's size and digests, those of the media, and its cosine hash.

    A null media gives nulls; a damaged one is an error. Equal media have equal values; rows may repeat.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def one(png: bytes | None) -> tuple:
        if png is None:
            return (None,) * 7
        pixels = decode_png(png)
        payload, found = pixels.tobytes(), cosine_hash(pixels)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), found.hex(), found

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, schema)
