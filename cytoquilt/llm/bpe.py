"""BPE encoding and decoding with forced boundaries (operator 3), and the encoder that other operators use.

A tokenizer file of the tokenizers library gives vocabulary and merges. Two
neighbouring bytes that occur side by side inside no vocabulary token can never
end up in one token, so the place between them is a certain cut: each fragment
between cuts is merged on its own and the ids are put one behind the other. All
fragments of a batch are merged together in numpy, one merge per fragment and
round, and white-space pieces that came before are taken from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, map_batches, quoted, tick

#: Pre-token patterns of the two files, which must be these for the ids to be right.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Separators that Python takes for white space and the patterns above do not.
NOT_SPACE = r"[\x1c-\x1f]"
#: White space that keeps a byte-level text from being cut at single spaces and line ends, for Arrow's regular expressions.
ODD_SPACE = r"  |\n\n|\n | \n|[\x01\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A[ \n]"
#: Letters beyond these were added to Unicode by and by; libraries differ in how many they know.
FOREIGN = re.compile("[^\x00-\u024f]")
MARKS = (".", ",", ";", ":", "!", "?")
#: Fragments of more symbols than this are merged with a heap, one by one.
LONG = 192
NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


#: Pieces of more characters are not kept, and what an entry takes besides its own bytes.
KEPT_PIECE, ENTRY = 64, 190


class PieceCache(dict):
    """Keeps the entries of the last two generations, each of about ``limit`` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held, self.old = limit, 0, {}

    def add(self, items: dict) -> bool:
        """Keeps the items if there is room; says whether all are kept."""
        if self.held >= self.limit or not items:
            return not items
        short = items if max(map(len, items)) <= KEPT_PIECE else {p: ids for p, ids in items.items() if len(p) <= KEPT_PIECE}
        self.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)
        return len(short) == len(items)

    def missing(self, pieces: set) -> list:
        """Pieces to compute; those of the older generation are brought over."""
        if self.held >= self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if not self.old:
            return list(pieces.difference(self))
        todo, kept = [], {}
        for p in pieces.difference(self):
            value = self.old.get(p)
            if value is None:
                todo.append(p)
            else:
                kept[p] = value
        # what finds no room is worked out once more
        return todo if self.add(kept) else todo + [p for p in kept if p not in self]


def require_format(spec: dict) -> None:
    """Fails on a file whose normaliser or splitter is not one of the two that the patterns above stand for."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
    split = [s["pattern"].get("Regex") for s in steps if s and s["type"] == "Split"]
    level = [(s["add_prefix_space"], s["use_regex"]) for s in steps if s and s["type"] == "ByteLevel"]
    normal = spec["normalizer"] or {}
    forms = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in normal.get("normalizers", [])]
    model = spec["model"]
    words = split == [WORDS.pattern] and level == [(False, False)] and forms == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
    plain = not split and level == [(False, True)] and not normal and not model.get("end_of_word_suffix")
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or not (words or plain):
        raise ValueError("a tokenizer file of another normaliser, splitter or model than the two known")


class BpeEncoder:
    """Ids of whole texts, as the library gives them without added special tokens."""

    def __init__(self, path: str, limit: int = 64 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        require_format(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self.token_array = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        special = "|".join(re.escape(x) for x in self.specials)
        self.odd_text = f"{special}|{NOT_SPACE if self.lowers else ODD_SPACE}"
        self._library = None
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        self._table(model["merges"])
        self._inside({c: b for b, c in enumerate(letters)})
        self.mark_ids = {m: np.array([self.last[ord(m)]], "<u4").tobytes() for m in MARKS} | {"": b""}
        self.cache = PieceCache(limit)

    def _table(self, merges: Sequence) -> None:
        """Open-addressing table from a pair of ids to (rank, merged id), probed for whole arrays at a time."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.bits = 18
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.full(size + 64, NONE, np.int64)
        self.merge_of: dict[int, int] = {}
        cut = len(self.suffix)
        for rank, (a, b) in enumerate(pairs):
            key = self.vocab[a] << 20 | self.vocab[b]
            if key in self.merge_of:
                continue
            self.merge_of[key] = rank << 20 | self.vocab[a + b if not cut else a.removesuffix(self.suffix) + b]
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.values[at] = key, self.merge_of[key]

    def _slot(self, key):
        return ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & np.int64((1 << self.bits) - 1)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id for each pair; NONE where there is no such merge."""
        key = a << np.int64(20) | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while open_.size:
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _inside(self, byte_of: dict[str, int]) -> None:
        """inside[x, y]: some vocabulary token has byte y right behind byte x. Elsewhere a cut is certain."""
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            codes = [byte_of[c] for c in body if c in byte_of]
            for x, y in zip(codes, codes[1:]):
                self.inside[x, y] = True

    # ---- merging
    def merge(self, pretokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one behind the other, and how many each has."""
        raw = [p.encode() for p in pretokens]
        return self.merge_bytes(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def merge_bytes(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, of pre-tokens given as bytes one behind the other, with the bytes of each."""
        n = data.size
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        ends = np.cumsum(sizes)
        starts = np.zeros(n, bool)
        starts[(ends - sizes)[sizes > 0]] = True
        starts[1:] |= ~self.inside[data[:-1], data[1:]]
        symbol = self.first[data]
        symbol[ends[sizes > 0] - 1] = self.last[data[ends[sizes > 0] - 1]]
        out = np.full(n, -1, np.int64)
        heads = np.flatnonzero(starts)
        lengths = np.diff(np.append(heads, n))
        out[heads[lengths == 1]] = symbol[heads[lengths == 1]]
        for h, k in zip(heads[lengths > LONG], lengths[lengths > LONG]):
            out[h : h + k] = self._heap(symbol[h : h + k].tolist())
        some = (lengths > 1) & (lengths <= LONG)
        heads, lengths = heads[some], lengths[some]
        if heads.size:
            first = np.cumsum(lengths) - lengths
            at = np.repeat(heads - first, lengths) + np.arange(lengths.sum())
            self._rounds(symbol[at], at, lengths, out)
        kept = out >= 0
        before = np.concatenate(([0], np.cumsum(kept)))
        return out[kept], before[ends] - before[ends - sizes]

    def _rounds(self, symbol, at, lengths, out) -> None:
        """One merge per fragment and round, the best pair first; fragments that have none left are written out."""
        first = np.cumsum(lengths) - lengths
        rank = np.full(symbol.size, NONE, np.int64)
        rank[:-1] = self._lookup(symbol[:-1], symbol[1:])
        rank[first + lengths - 1] = NONE
        place = np.arange(symbol.size)
        while True:
            # the leftmost of the best: ranks are below 2**17, positions get the low bits
            best = np.minimum.reduceat(np.where(rank == NONE, NONE, (rank >> 20) << 32 | place[: rank.size]), first)
            going = best != NONE
            if not going.all():
                done = np.repeat(~going, lengths)
                out[at[done]] = symbol[done]
                keep = ~done
                shift = np.cumsum(keep) - 1
                symbol, at, rank = symbol[keep], at[keep], rank[keep]
                best, lengths = best[going], lengths[going]
                if not best.size:
                    return
                pos = shift[best & 0xFFFFFFFF]
                first = np.cumsum(lengths) - lengths
            else:
                pos = best & 0xFFFFFFFF
            symbol[pos] = rank[pos] & 0xFFFFF
            gone = np.ones(symbol.size, bool)
            gone[pos + 1] = False
            tail = pos + 1 == first + lengths - 1  # the merged symbol is now the fragment's last
            pos = pos - np.arange(pos.size)  # each fragment before lost one symbol
            symbol, at, rank = symbol[gone], at[gone], rank[gone]
            lengths = lengths - 1
            first = np.cumsum(lengths) - lengths
            nxt = np.minimum(pos + 1, symbol.size - 1)
            rank[pos] = np.where(tail, NONE, self._lookup(symbol[pos], symbol[nxt]))
            left = pos > first
            p = pos[left]
            rank[p - 1] = self._lookup(symbol[p - 1], symbol[p])

    def _heap(self, symbols: list[int]) -> list[int]:
        """Merges of one long fragment in O(n log n); merged places are left at -1."""
        n, merge_of = len(symbols), self.merge_of
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := merge_of.get(symbols[i] << 20 | symbols[j])) is not None:
                heap.append((m >> 20, i, symbols[i], symbols[j], m & 0xFFFFF))

        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    size = len(heap)
                    offer(k)
                    if len(heap) > size:
                        item = heap.pop()
                        heapq.heappush(heap, item)
        return symbols

    # ---- cutting texts
    def _pretokens(self, piece: str) -> list[str]:
        """Pre-tokens of one piece; most are letters with at most one mark behind them."""
        if self.lowers:
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                if FOREIGN.search(piece):
                    return self._library_cut(piece)
            piece = piece.lower()
            body = piece
        elif piece == "\n":
            return [piece]
        else:
            bare = piece[:1] == "\x01"
            body = piece[1:] if bare else piece
            piece = body if bare else " " + body
        if body.isalpha():
            return [piece]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return (WORDS if self.lowers else BYTES).findall(piece)

    def _plain(self, todo: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """(which pieces are ASCII letters with at most one mark behind them, ids of these), the letters all merged together in arrays."""
        body = pa.array(todo, pa.string())
        if not self.lowers:
            bare = pc.starts_with(body, "\x01")
            body = pc.if_else(bare, pc.utf8_slice_codeunits(body, 1), body)
        last = pc.utf8_slice_codeunits(body, -1)
        marked = pc.is_in(last, value_set=pa.array(MARKS))
        stem = pc.if_else(marked, pc.utf8_slice_codeunits(body, 0, -1), body)
        ok = pc.ascii_is_alpha(stem)
        if self.lowers:
            text = pc.ascii_lower(stem)
        else:
            text = pc.if_else(bare, stem, pc.binary_join_element_wise(pa.scalar(" "), stem, pa.scalar("")))
        text = text.filter(ok)
        sizes = pc.binary_length(text).to_numpy().astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
        ids, counts = self.merge_bytes(data, sizes)
        cut = np.concatenate(([0], np.cumsum(counts) * 4)).tolist()
        raw, ends = ids.astype("<u4").tobytes(), pc.if_else(marked, last, "").filter(ok).to_pylist()
        return ok.to_numpy(zero_copy_only=False), [raw[a:b] + self.mark_ids[m] for a, b, m in zip(cut, cut[1:], ends)]

    def _library_cut(self, text: str) -> list[str]:
        """Where newer letters may be classed otherwise, the library's own normaliser and splitter decide."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        if self._library is None:
            lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self._library = (lower, pre_tokenizers.Split(Regex(WORDS.pattern), "removed", invert=True))
        lower, split = self._library
        return [p for p, _ in split.pre_tokenize_str(lower.normalize_str(text))]

    def _odd(self, text: str) -> list:
        """A text that can't be cut at white space: pre-tokens, and ids of special tokens."""
        parts = []
        for k, part in enumerate(self.special_re.split(text)):
            if k % 2:
                parts.append(self.specials[part])
            elif part and self.lowers:
                parts += self._library_cut(part)
            elif part:
                parts += BYTES.findall(part)
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other (uint32), and where each text begins, with the end behind the last.

        A null text counts as empty.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd_rows = np.flatnonzero(pc.match_substring_regex(texts, self.odd_text).to_numpy(zero_copy_only=False))
        odd = [self._odd(texts[int(i)].as_py()) for i in odd_rows]
        if odd_rows.size:
            mask = np.zeros(n, bool)
            mask[odd_rows] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        if self.lowers:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            filled = pc.not_equal(texts, "")
            start = pa.scalar("\x01", pa.large_string())
            marked = pc.binary_join_element_wise(start, pc.replace_substring(texts, "\n", " \n \x01"), pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(pc.if_else(filled, marked, start), " ")
        flat = lists.flatten().dictionary_encode()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        index = flat.indices.to_numpy()
        pieces = flat.dictionary.to_pylist()
        todo = self.cache.missing(set(pieces))
        plain, done = self._plain(todo)
        new = dict(zip(itertools.compress(todo, plain), done))
        todo = list(itertools.compress(todo, ~plain))
        pre = [self._pretokens(p) if p or not self.lowers else [] for p in todo]
        loose = [[x for x in parts if isinstance(x, str)] for parts in odd]
        counts = np.fromiter(map(len, [*pre, *loose]), np.int64, len(pre) + len(loose))
        ids, sizes = self.merge([x for p in pre for x in p] + [x for p in loose for x in p])
        pretoken_at = np.concatenate(([0], np.cumsum(sizes)))
        piece_at = np.concatenate(([0], np.cumsum(counts)))
        data, cut = ids.astype("<u4").tobytes(), (pretoken_at[piece_at] * 4).tolist()
        new.update((p, data[cut[i] : cut[i + 1]]) for i, p in enumerate(todo))
        if self.cache.add(new):
            found = list(map(self.cache.__getitem__, pieces))
        else:
            found = [new[p] if p in new else self.cache[p] for p in pieces]
        unique = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(4)
        begin = np.cumsum(length, dtype=np.int32) - length
        # every occurrence of a piece takes that piece's run of ids; a slice has far fewer than 2**31
        per = length[index] if index.size else np.zeros(0, np.int32)
        upto = np.zeros(per.size + 1, np.int64)
        np.cumsum(per, out=upto[1:])
        take = np.repeat(begin[index] - upto[:-1].astype(np.int32), per) if index.size else np.zeros(0, np.int32)
        take += np.arange(take.size, dtype=np.int32)
        out = unique[take]
        offsets = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not odd:
            return out, offsets
        rows = np.split(out, offsets[1:-1])
        pretoken, k = np.cumsum(counts)[len(pre) - 1] if pre else 0, 0
        for row, parts in zip(odd_rows.tolist(), odd):
            run = []
            for x in parts:
                if isinstance(x, str):
                    run.append(ids[pretoken_at[pretoken] : pretoken_at[pretoken + 1]])
                    pretoken += 1
                else:
                    run.append(np.array([x]))
            rows[row] = np.concatenate(run).astype("<u4") if run else np.zeros(0, "<u4")
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Vocabulary tokens with a space between, as the library decodes where a file names no decoder."""
        tokens = self.token_array.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens), " ")


_ENCODERS: dict[tuple[str, int], BpeEncoder] = {}


def encoder(path: str, limit: int = 64 << 20) -> BpeEncoder:
    """One encoder a worker process, file and size of cache; the next task of the worker finds its cache warm."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = BpeEncoder(path, limit)
    return _ENCODERS[path, limit]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def sha256_of(part: bytes | memoryview) -> str:
    return hashlib.sha256(part).hexdigest()


def encode_decode(df: DataFrame, id_col: str, text_col: str, name: str = "word_bpe_49k.json", keep_ids: bool = True) -> DataFrame:
    """Ids and decoded text of every row.

    Returns (id, ids array<int>, decoded string, n_tokens, ids_sha256,
    decoded_sha256); without ``keep_ids`` the two large columns are left out, and
    a column named as the id column gets its name with ``_`` behind. A
    null or empty text has no ids and decodes to the empty string; repeated rows
    give repeated results. ``name`` is looked up on each worker.
    """

    def make():
        bpe = encoder(vocabulary(name))

        def work(batch: pa.RecordBatch) -> list:
            ids, offsets = bpe.encode(batch.column(1))
            decoded = bpe.decode(ids, offsets)
            raw, cut = memoryview(ids.tobytes()), (offsets * 4).tolist()
            spoken = decoded.to_pylist()
            large = [pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)), decoded] if keep_ids else []
            return [
                batch.column(0),
                *large,
                np.diff(offsets),
                [sha256_of(raw[a:b]) for a, b in zip(cut, cut[1:])],
                [sha256_of(x.encode()) for x in spoken],
            ]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    names = fresh(df.select(quoted(id_col)), "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    kinds = ["array<int>", "string", "bigint", "string", "string"]
    columns = ", ".join(f"{n} {k}" for n, k in list(zip(names, kinds))[0 if keep_ids else 2 :])
    schema = f"{tick(id_col)} {kind}, {columns}"
    return map_batches(df.select(quoted(id_col), quoted(text_col)), make, schema)


def packed(df: DataFrame, id_col: str, text_col: str, name: str = "word_bpe_49k.json") -> DataFrame:
    """(id, ids binary, decoded string): the ids of every row as little-endian unsigned 32-bit integers, and the text they decode to.

    Edge cases as in ``encode_decode``.
    """
    ids_name, text_name = fresh(df.select(quoted(id_col)), "ids", "decoded")

    def make():
        bpe = encoder(vocabulary(name))

        def work(batch: pa.RecordBatch) -> list:
            ids, offsets = bpe.encode(batch.column(1))
            cut = pa.py_buffer((offsets * 4).astype("<i4"))
            return [batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, cut, pa.py_buffer(ids.astype("<u4"))]), bpe.decode(ids, offsets)]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    return map_batches(df.select(quoted(id_col), quoted(text_col)), make, f"{tick(id_col)} {kind}, {ids_name} binary, {text_name} string", size=3 << 20)


def digests(df: DataFrame, id_col: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) from the two columns that ``packed`` adds."""
    ids, decoded = (c for c in df.columns if c != id_col)
    n_tokens, ids_hash, text_hash = fresh(df.select(quoted(id_col)), "n_tokens", "ids_sha256", "decoded_sha256")
    return df.select(
        quoted(id_col), (F.octet_length(ids) / 4).cast("long").alias(n_tokens), F.sha2(quoted(ids), 256).alias(ids_hash),
        F.sha2(quoted(decoded), 256).alias(text_hash),
    )
