import hashlib
import struct
import zlib

import numpy as np
import pytest
from fixtures import SCHEMA, edge_rows

from cytoquilt.llm import media


def filter_line(kind, row, up):
    """One PNG row filter, sample by sample."""
    out = []
    for i, x in enumerate(row):
        a, b, c = (int(row[i - 3]) if i > 2 else 0), int(up[i]), (int(up[i - 3]) if i > 2 else 0)
        if kind == 4:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        else:
            guess = (0, a, b, (a + b) // 2)[kind]
        out.append((int(x) - guess) & 255)
    return bytes([kind, *out])


def test_all_filters_are_undone():
    rows = np.random.default_rng(1).integers(0, 256, (12, media.ROW), dtype=np.uint8)
    up = np.vstack((np.zeros((1, media.ROW), np.uint8), rows[:-1]))
    kinds = [0, 1, 2, 2, 3, 4, 4, 1, 3, 2, 0, 4]
    lines = b"".join(filter_line(k, r, u) for k, r, u in zip(kinds, rows, up))
    head = struct.pack(">IIBBBBB", 64, 12, 8, 2, 0, 0, 0)
    body = zlib.compress(lines)
    png = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", body[:100]) + media.chunk(b"IDAT", body[100:]) + media.chunk(b"IEND", b"")
    assert np.array_equal(media.decode_png(png), rows)


def test_damage_is_seen():
    png = bytearray(media.encode_png(b"x" * 384))
    png[45] ^= 1
    for bad in (bytes(png), bytes(png[:-8]), b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_hash_follows_low_frequencies():
    rng = np.random.default_rng(2)
    smooth = (128 + 60 * np.sin(np.arange(64) / 9)[None, :, None] * np.cos(np.arange(96) / 11)[:, None, None] * np.ones((1, 1, 3))).astype(np.uint8)
    noisy = np.clip(smooth + rng.integers(-4, 5, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, smooth.shape, dtype=np.uint8)
    a, b, c = (np.unpackbits(np.frombuffer(media.picture_hash(x.reshape(96, -1)), np.uint8)) for x in (smooth, noisy, other))
    assert (a != b).sum() < 12 < (a != c).sum()


def test_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = media.to_media(df, "doc_id", "text").collect()
    wanted = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        wanted.append(str((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))))
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(wanted)
    for r in got:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert hashlib.sha256(media.decode_png(bytes(r.media)).tobytes()).hexdigest() == r.payload_sha256
        assert r.feature == bytes(r.feature_bits).hex() and len(r.feature_bits) == 8
    assert media.to_media(df.limit(0), "doc_id", "text").count() == 0


def test_digests_come_from_stored_columns(spark, monkeypatch):
    from cytoquilt.llm import bpe, registry

    docs = spark.createDataFrame([(r[0], r[1]) for r in edge_rows()], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(registry, "read_table", lambda *a: docs)
    written = []
    write = type(docs.write).parquet
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, path, *a, **b: (written.append(path), write(self, path, *a, **b))[1])
    got = registry.op10_png_media(spark, "")
    kept = spark.read.parquet(written[-1])
    assert dict(kept.dtypes)["media"] == "binary" and kept.count() == docs.count()
    assert dict(media.read_media(kept, "doc_id").dtypes)["feature_bits"] == "binary"
    direct = media.to_media(docs, "doc_id", "text", keep_media=False)
    assert got.columns == direct.columns and sorted(map(str, got.collect())) == sorted(map(str, direct.collect()))
    tokens, direct = registry.op3_forced_boundary_bpe(spark, ""), bpe.encode_decode(docs, "doc_id", "text", keep_ids=False)
    assert tokens.columns == direct.columns and sorted(map(str, tokens.collect())) == sorted(map(str, direct.collect()))


def test_pipeline_keeps_tokens(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert all(len(r["ids"]) == r["length"] for r in rows) and len(rows) == 2


def test_hash_by_plain_sums():
    """The lowest frequencies of the shrunk grey picture, worked out sum by sum."""
    import math

    rng = np.random.default_rng(4)
    for n in (1, 7, 32, 45):
        samples = rng.integers(0, 256, (n, media.ROW), dtype=np.uint8)
        side, step = media.SIDE, media.ROW // media.SIDE
        columns = [[sum(int(v) for v in row[x * step : (x + 1) * step]) for x in range(side)] for row in samples]
        grey = []
        for y in range(side):
            if n < side:
                grey.append([float(v) for v in columns[y * n // side]])
            else:
                own = columns[y * n // side : (y + 1) * n // side]
                grey.append([sum(r[x] for r in own) / len(own) for x in range(side)])
        low = [
            sum(grey[y][x] * math.cos(math.pi * u * (2 * y + 1) / (2 * side)) * math.cos(math.pi * v * (2 * x + 1) / (2 * side)) for y in range(side) for x in range(side))
            for u in range(media.LOW) for v in range(media.LOW)
        ]
        rest = sorted(low[1:])
        middle = rest[len(rest) // 2]
        bits = np.unpackbits(np.frombuffer(media.picture_hash(samples), np.uint8))
        assert all(bool(b) == (x > middle) for b, x in zip(bits, low) if abs(x - middle) > 1e-6 * max(map(abs, low)))
