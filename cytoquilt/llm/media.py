"""Bytes as PNG pictures and back, with a low-frequency picture hash (operator 10).

A payload is laid out in rows of 192 bytes (64 RGB pixels of 8-bit samples). The
encoder filters rows with numpy, deflates them with zlib and writes chunks with
checksums; the decoder tests signature and checksums, inflates, and undoes all
five row filters. The hash is the sign pattern of the lowest cosine-transform
frequencies of the grey picture.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cytoquilt.llm.common import fresh, map_batches, quoted, tick

ROW = 192
PIXEL = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


def pad(data: bytes) -> bytes:
    """``data`` and then spaces up to a positive multiple of a row."""
    return data + b" " * ((-len(data)) % ROW or (0 if data else ROW))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with a filter byte each: none, left neighbour or upper neighbour, whichever has the smallest sum."""
    left = rows.copy()
    left[:, PIXEL:] -= rows[:, :-PIXEL]
    up = rows.copy()
    up[1:] -= rows[:-1]
    weight = [np.abs(r.view(np.int8).astype(np.int16)).sum(1) for r in (rows, left, up)]
    kind = np.argmin(np.stack(weight), 0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], left, up))
    return out


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """The samples behind filtered rows; all five filters of the format."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown PNG row filter")
    n = len(out)
    left = kind == 1
    if left.any():
        out[left] = np.cumsum(out[left].reshape(left.sum(), -1, PIXEL), 1, dtype=np.uint8).reshape(left.sum(), -1)
    y = 0
    while y < n:
        k = kind[y]
        if k == 2:  # a run of them is one running sum down the columns
            end = y
            while end < n and kind[end] == 2:
                end += 1
            above = out[y - 1 : y] if y else np.zeros((1, out.shape[1]), np.uint8)
            out[y:end] = np.cumsum(np.concatenate((above, out[y:end])), 0, dtype=np.uint8)[1:]
            y = end
            continue
        if k > 2:
            up = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
            _unfilter_row(out[y], up, int(k))
        y += 1
    return out


def _unfilter_row(row: np.ndarray, up: np.ndarray, kind: int) -> None:
    """Average and Paeth: each pixel needs the one before it."""
    above, a, c = up.astype(np.int64), np.zeros(PIXEL, np.int64), np.zeros(PIXEL, np.int64)
    for x in range(0, row.size, PIXEL):
        b = above[x : x + PIXEL]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa_, pb, pc_ = np.abs(p - a), np.abs(p - b), np.abs(p - c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
        a = (row[x : x + PIXEL] + guess) & 255
        row[x : x + PIXEL] = a
        c = b


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // PIXEL, len(rows), 8, 2, 0, 0, 0)
    body = zlib.compress(filtered(rows).tobytes(), level)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (rows, bytes a row). Raises ValueError on a damaged or foreign file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, body, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("PNG file cut short")
        size = struct.unpack_from(">I", data, at)[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError(f"checksum of PNG chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("only 8-bit RGB without interlacing is read")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfiltered(lines.reshape(head[1], head[0] * PIXEL + 1))


def cosine_basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


BASIS = cosine_basis()


def picture_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the grey picture, shrunk to 32 x 32 by area, exceed their median."""
    n = len(samples)
    grey = samples.reshape(n, SIDE, -1).sum(2, dtype=np.float64)
    if n < SIDE:
        grey = grey[np.arange(SIDE) * n // SIDE]
    else:
        edges = np.arange(SIDE) * n // SIDE
        grey = np.add.reduceat(grey, edges) / np.diff(np.append(edges, n))[:, None]
    low = BASIS @ grey @ BASIS.T
    low = low.ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(df: DataFrame, id_col: str, text_col: str, keep_media: bool = True) -> DataFrame:
    """Each text as a stored picture, read back, with digests and the hash.

    Returns (id, media binary, feature_bits binary, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature); without
    ``keep_media`` the two binary columns are left out. A null or empty text is a
    picture of one row of spaces; repeated rows give repeated results; a picture
    that does not read back to its payload fails the task.
    """

    def make():
        def one(raw: bytes) -> tuple:
            payload = pad(raw)
            media = encode_png(payload)
            samples = decode_png(media)
            back = samples.tobytes()
            if back != payload:
                raise ValueError("stored picture does not give its payload back")
            bits = picture_hash(samples)
            return (
                media, bits, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
                len(media), hashlib.sha256(media).hexdigest(), bits.hex(),
            )

        def work(batch: pa.RecordBatch) -> list:
            raw = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            rows = [one(raw[i].as_py()) for i in range(len(raw))]
            out = list(map(list, zip(*rows)))
            return [batch.column(0), *(out if keep_media else out[2:])]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    large = "media binary, feature_bits binary, " if keep_media else ""
    schema = (
        f"`{id_col}` {kind}, {large}n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return map_batches(df.select(quoted(id_col), quoted(text_col)), make, schema)


def store_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, media binary, n_bytes) to be stored: each text as a picture. Edge cases as in ``to_media``."""
    media, n_bytes = fresh(df.select(quoted(id_col)), "media", "n_bytes")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            raw = [x.as_py() for x in pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")]
            return [batch.column(0), [encode_png(pad(x)) for x in raw], [len(x) for x in raw]]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    return map_batches(df.select(quoted(id_col), quoted(text_col)), make, f"{tick(id_col)} {kind}, {media} binary, {n_bytes} bigint")


def read_media(df: DataFrame, id_col: str) -> DataFrame:
    """Digests and hash of stored pictures, all from the bytes read back.

    ``df`` holds what ``store_media`` gives. The result has the digests that
    ``to_media`` gives, ``feature_bits`` first, worked out from the decoded
    samples. A damaged picture fails the task.
    """
    media, n_bytes = (c for c in df.columns if c != id_col)
    names = fresh(df.select(quoted(id_col)), "feature_bits", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def make():
        def one(media: bytes) -> tuple:
            samples = decode_png(media)
            back, bits = samples.tobytes(), picture_hash(samples)
            return bits, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), bits.hex()

        def work(batch: pa.RecordBatch) -> list:
            bits, *rows = map(list, zip(*[one(m.as_py()) for m in batch.column(1)]))
            return [batch.column(0), bits, batch.column(2), *rows]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    kinds = ["binary", "bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    schema = f"{tick(id_col)} {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return map_batches(df.select(quoted(id_col), quoted(media), quoted(n_bytes)), make, schema)
