import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, edge_rows

from cytoquilt.llm import bpe, packing, wavelet

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

PARTS = ["'s", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|",
         "é", "é", "İ", "Σ", "ΑΣ", "ß", "ﬁ", "ab", "Th", "12", "3", ".", "...", "世界", "😀", "\r\n", "½", "\x00", "\x01", "aaaa", "́"]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(n)] + ["ab" * 500, "é" * 700, "\n" * 300, " " * 200]


def library(name):
    return Tokenizer.from_file(bpe.vocabulary(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_librarys(name):
    texts = random_texts(4000)
    ids, offsets = bpe.BpeEncoder(bpe.vocabulary(name), limit=500).encode(pa.array(texts))
    wanted = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == wanted


def test_cache_generations_do_not_change_ids():
    texts = [f"word{i} other{i % 7}, thing{i % 3}." for i in range(300)]
    whole = bpe.BpeEncoder(bpe.vocabulary("word_bpe_49k.json")).encode(pa.array(texts))
    small = bpe.BpeEncoder(bpe.vocabulary("word_bpe_49k.json"), limit=20)
    parts = [small.encode(pa.array(texts[i : i + 10]))[0] for i in range(0, 300, 10)]
    assert np.array_equal(whole[0], np.concatenate(parts))


def test_cuts_are_certain():
    coder = bpe.BpeEncoder(bpe.vocabulary("byte_bpe_50k.json"))
    assert coder.inside[ord("t"), ord("h")] and not coder.inside.all()
    long = "ab" * 400  # above the length where the heap takes over
    assert coder.encode(pa.array([long]))[0].tolist() == library("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids


def test_encode_decode_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lib = library("word_bpe_49k.json")
    out = bpe.encode_decode(df, "doc_id", "text").collect()
    wanted = sorted(str((r[0], lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted(str((r.doc_id, r.ids)) for r in out) == wanted
    for r in out:
        assert r.decoded == lib.decode(r.ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), "doc_id", "text").count() == 0


# ---- packing
def least_sequences(counts, size):
    """Lower bound: pieces above half need a sequence each, and smaller ones fill what these leave."""
    items, best = [k for k, n in counts.items() for _ in range(n)], 0
    for a in range(size // 2 + 1):
        big, mid = [k for k in items if k > size - a], [k for k in items if size / 2 < k <= size - a]
        small = sum(k for k in items if a <= k <= size / 2)
        best = max(best, len(big) + len(mid) + max(0, -(-(small - (len(mid) * size - sum(mid))) // size)))
    return best


def test_minimum_slack_places_all_and_is_tight():
    rnd = random.Random(3)
    for _ in range(30):
        size = rnd.choice([10, 37, 64])
        counts = {k: rnd.randint(0, 9) for k in range(1, size + 1)}
        plan = packing.minimum_slack(counts, size)
        placed = dict.fromkeys(counts, 0)
        for times, parts in plan:
            assert times > 0 and sum(k * n for k, n in parts) <= size
            for k, n in parts:
                placed[k] += n * times
        assert placed == counts
        assert sum(t for t, _ in plan) <= 1.03 * least_sequences(counts, size) + 1


def test_fullest_is_the_best_subset():
    rnd = random.Random(4)
    for _ in range(200):
        items = [rnd.randint(1, 15) for _ in range(rnd.randint(0, 8))]
        room = rnd.randint(0, 40)
        counts = [items.count(k) for k in range(41)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        chosen = packing.fullest(counts, room)
        assert sum(k * n for k, n in chosen) == max(sums) and all(n <= counts[k] for k, n in chosen)


@pytest.mark.parametrize("size", [16, 1024])
def test_pack_edges(spark, size):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lib = library("byte_bpe_50k.json")
    got = packing.pack(df, "doc_id", "text", size=size, keep_ids=True, bucket_rows=8).collect()
    wanted = []
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // size)
        head = len(ids) - (n - 1) * size
        cuts = [0, *[head + k * size for k in range(n)]]
        wanted += [str((r[0], k, a, ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.ids)) for r in got) == sorted(wanted)
    places = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(places) <= -(-sum(r.length for r in got) // size) + 1
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# ---- wavelet matrices
@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (7, 1), (513, 40_000), (5000, 3), (4096, 65_535)])
def test_wavelet_matrix_answers(n, top):
    rnd = np.random.default_rng(n)
    ids = rnd.integers(0, top + 1, n)
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([n])))
    assert np.array_equal(m.all(), ids)
    if n:
        at = rnd.integers(0, n, 50)
        assert np.array_equal(m.access(at), ids[at])
    for token in {0, top, top + 1, *ids[:3].tolist()}:
        assert m.count(token) == (ids == token).sum()
        assert m.count(token, n // 3, 2 * n // 3) == (ids[n // 3 : 2 * n // 3] == token).sum()
        if (ids == token).sum() < 60:
            assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_wavelet_image_is_checked():
    image = bytearray(wavelet.build(np.arange(100), np.array([60, 40])))
    image[40] ^= 1
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(bytes(image))


def test_shards_edges(spark, tmp_path):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lib = library("word_bpe_49k.json")
    folder = f"file://{tmp_path}/shards"
    wavelet.write_shards(df, "doc_id", "text", folder, shard_tokens=300)
    got = wavelet.read_shards(spark, folder, "doc_id").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    wanted = []
    for r in rows:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append(str((r[0], len(ids), zlib.crc32(ids.tobytes()))))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(wanted)
    assert spark.read.parquet(folder).count() > 1
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    dot = lib.encode("a.b", add_special_tokens=False).ids[1]
    for token in (1, dot):
        asked = wavelet.read_shards(spark, folder, "doc_id", ask=token).collect()
        for r in (r for r in asked if r.doc_id is not None):
            ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert r.asked_count == ids.count(token)
            assert r.asked_last == (len(ids) - 1 - ids[::-1].index(token) if token in ids else None)
    empty = f"file://{tmp_path}/empty"
    wavelet.write_shards(df.limit(0), "doc_id", "text", empty)
    assert wavelet.read_shards(spark, empty, "doc_id").count() == 0


def test_a_small_cache_gives_the_same_ids():
    """An encoder may be asked for with a cache of its own size, which bounds what it holds and changes no ids."""
    from cytoquilt.llm.bpe import encoder, vocabulary

    path = vocabulary("byte_bpe_50k.json")
    small, usual = encoder(path, 1 << 16), encoder(path)
    assert small is not usual and small is encoder(path, 1 << 16)
    for k in range(5):
        texts = pa.array([f"word{i * 7919 + k} and x{i}y{k}\nline" for i in range(3000)])
        for a, b in zip(small.encode(texts), usual.encode(texts)):
            assert (a == b).all()
    assert small.cache.limit == 1 << 16 and len(small.cache) < len(usual.cache)
