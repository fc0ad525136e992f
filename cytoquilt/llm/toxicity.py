"""Toxicity by a weighted lexicon (operator 9).

Text is folded first: case, accents, look-alike letters of other scripts, and
digits that stand for letters. A lexicon of words and word beginnings is learned
from labelled rows, each with its log-odds less one standard error. All entries
are found in one Aho-Corasick pass over the folded words; a word counts with its
heaviest entry, unless it stands in an exception phrase. Sums are normalised by
length, and a logistic curve turns them into a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, map_batches, quoted, tick
from cytoquilt.session import materialize

#: Cyrillic and Greek letters that look like Latin ones, and digits read as letters.
LOOK_ALIKE = str.maketrans("аеорсухіјѕкмтвнԁαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХІЅЈ", "aeopcyxijskmtbhdabeiknoptuxabezhikmnoptyxabekmhopctxisj")
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGN = re.compile(rb"(?<=[a-z])[$@](?=[a-z])")
SHORTEST, LONGEST = 4, 8  # letters of a word beginning


def fold_table() -> bytes:
    """Latin-1 byte to folded letter; everything else becomes a space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        base = unicodedata.normalize("NFKD", chr(b))[:1].lower()
        letter = DIGITS.get(chr(b), base if "a" <= base <= "z" else None)
        if letter:
            table[b] = ord(letter)
    table[0xDF] = ord("s")
    table[ord("$")], table[ord("@")] = ord("$"), ord("@")
    return bytes(table)


TABLE = fold_table()


WORD = re.compile(r"\w+")
LATIN = re.compile("[A-Za-z]")


def is_foreign(word: str) -> bool:
    """Whether letters beyond Latin-1 outweigh its own."""
    letters = [c for c in word if c.isalpha()]
    return sum(c > "\xff" for c in letters) * 2 > len(letters)


def fold_scripts(text: str) -> list[str]:
    """Folded words of a text with letters beyond Latin-1.

    Look-alikes are folded in words that have Latin letters, and in words of
    nothing but look-alikes where the text is mostly Latin. Words of another
    script keep their letters, without case and marks.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    latin = not is_foreign(plain)
    out: list[str] = []

    def word(m: re.Match) -> str:
        own = m.group()
        if own.isascii():
            return own
        changed = own.translate(LOOK_ALIKE)
        letters = "".join(c for c in changed if c.isalpha())
        if (LATIN.search(own) or latin) and max(letters, default="") <= "\xff":
            return changed
        out.append(own.casefold())
        return " "

    rest = WORD.sub(word, plain)
    return fold_latin(rest.encode("latin-1", "replace").replace(b"?", b" ")) + out


def fold(text: str) -> list[str]:
    """Folded words of a text; words of other scripts come last."""
    try:
        return fold_latin(text.encode("latin-1"))
    except UnicodeEncodeError:
        return fold_scripts(text)


def fold_latin(raw: bytes) -> list[str]:
    low = raw.translate(TABLE)
    if b"$" in low or b"@" in low:
        low = SIGN.sub(lambda m: b"s" if m.group() == b"$" else b"a", low).replace(b"$", b" ").replace(b"@", b" ")
    return low.decode("ascii").split()


def entries(word: str) -> list[str]:
    """Lexicon entries that a word matches: itself between spaces, and its beginnings."""
    if len(word) < 3:
        return []
    return [f" {word} ", *(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


@dataclass(frozen=True)
class Model:
    """Entry weights, exception phrases (phrase -> place of the word that it excuses), and the curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, int] = field(default_factory=dict)
    curve: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        for phrase, at in self.exceptions.items():
            found.add_word(phrase, (len(phrase), -1 - at))
        found.make_automaton()
        return found


def matched(automaton, words: list[str]) -> tuple[str, dict[int, float]]:
    """The folded text, and the weight at the place of each word that counts."""
    text = f" {' '.join(words)} "
    best: dict[int, float] = {}
    excused = set()
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight < 0:
            excused.add(start - 1 - int(weight))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return text, {k: w for k, w in best.items() if k not in excused}


def features(weights: dict[int, float], n_words: int) -> tuple[float, ...]:
    """Sum over the root of the length, sum over the length, and the heaviest word."""
    total = sum(weights.values())
    return 1.0, total / (n_words + 10) ** 0.5, 10 * total / (n_words + 20), max(weights.values(), default=0.0)


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(text, toxic, half) of at most ``per_class`` labelled rows of either class, those of lowest hash; two halves of the hash."""
    known = labels.where(quoted(label_col).isNotNull() & quoted(id_col).isNotNull() & ~held_out(quoted(id_col)))
    known = known.groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col).cast("int")).alias("toxic"))
    known = known.withColumn("rank", F.xxhash64("id"))
    chosen = known.where("toxic = 1").orderBy("rank", "id").limit(per_class).unionByName(known.where("toxic = 0").orderBy("rank", "id").limit(per_class))
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    # at most 2 * per_class ids
    found = rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    return found.select("text", "toxic", F.pmod("rank", F.lit(2)).cast("int").alias("half"))


def entry_counts(sample: DataFrame) -> DataFrame:
    """(half, entry, pos, neg): in how many texts of either class an entry matches; summed in the task first."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            seen: Counter = Counter()
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                seen.update((half, toxic, e) for e in {e for w in set(fold(text)) for e in entries(w)})
            keys = list(seen)
            n = np.array([seen[k] for k in keys], np.int64)
            toxic = np.array([k[1] for k in keys], np.int64)
            return [[k[0] for k in keys], [k[2] for k in keys], n * toxic, n * (1 - toxic)]

        return work

    parts = map_batches(sample, make, "half int, entry string, pos bigint, neg bigint")
    return parts.groupBy("half", "entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def weighted(counts: DataFrame, pos: int, neg: int, support: int, size: int) -> dict[str, float]:
    """The ``size`` heaviest entries: log-odds less a standard error, above 1."""
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    weight = F.log(p / (pos + 1)) - F.log(n / (neg + 1)) - F.sqrt(1 / p + 1 / n)
    top = counts.where(F.col("pos") >= support).select("entry", weight.alias("weight")).where("weight > 1").orderBy(F.desc("weight"), "entry").limit(size)
    return {r[0]: r[1] for r in top.collect()}


def sample_features(sample: DataFrame, model: Model) -> DataFrame:
    def make():
        found = model.automaton() if model.lexicon else None

        def work(batch: pa.RecordBatch) -> list:
            rows = []
            for text in batch.column(0).to_pylist():
                words = fold(text)
                rows.append(features(matched(found, words)[1] if found else {}, len(words)))
            return [batch.column(1), *(np.array(c) for c in zip(*rows))]

        return work

    return map_batches(sample.select("text", "toxic"), make, "toxic int, f0 double, f1 double, f2 double, f3 double")


def exception_phrases(sample: DataFrame, model: Model, support: int, most: int) -> dict[str, int]:
    """Two-word phrases around a lexicon word that ``support`` clean texts have and no toxic one."""

    def make():
        found = model.automaton()

        def work(batch: pa.RecordBatch) -> list:
            out: Counter = Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                folded, weights = matched(found, fold(text))
                phrases = set()
                for at in weights:
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    if before >= 0:
                        phrases.add((folded[before : end + 1], at - before))
                    if after >= 0:
                        phrases.add((folded[at : after + 1], 0))
                out.update((*p, toxic) for p in phrases)
            keys = list(out)
            n, toxic = np.array([out[k] for k in keys], np.int64), np.array([k[2] for k in keys], np.int64)
            return [[k[0] for k in keys], [k[1] for k in keys], n * toxic, n * (1 - toxic)]

        return work

    parts = map_batches(sample.select("text", "toxic"), make, "phrase string, place int, pos bigint, neg bigint")
    sums = parts.groupBy("phrase", "place").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = sums.where((F.col("pos") == 0) & (F.col("neg") >= support)).orderBy(F.desc("neg"), "phrase", "place").limit(most)
    return {r[0]: r[1] for r in top.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients by Newton steps, lightly shrunk."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 8_000,
    lexicon_size: int = 5_000, support: int = 4, exceptions: dict[str, int] | None = None, most_exceptions: int = 1_000,
) -> Model:
    """Learn lexicon, exception phrases and curve from labelled rows outside the held-out third.

    At most ``per_class`` labelled rows of either class are used, those of lowest
    hash. The curve is fitted on one half of them with entries learned from the
    other half. Null labels and labels without a document are left out; with no
    row of one class the model is empty and scores 0. ``exceptions`` adds phrases
    (" a b ", with the place of the excused word's leading space).
    """
    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, per_class))
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1))).collect()}
    pos, neg = (sum(n for (_, t), n in sizes.items() if t == k) for k in (1, 0))
    if not pos or not neg:
        return Model()
    counts = materialize(entry_counts(sample))
    first = Model(weighted(counts.where("half = 0").select("entry", "pos", "neg"), sizes.get((0, 1), 0), sizes.get((0, 0), 0), max(2, support // 2), lexicon_size))
    whole = counts.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    full = Model(weighted(whole, pos, neg, support, lexicon_size))
    excused = exception_phrases(sample, full, support, most_exceptions) if full.lexicon else {}
    rows = sample_features(sample.where("half = 1"), first).toPandas().to_numpy(float)
    curve = logistic(rows[:, 1:], rows[:, 0]) if len(rows) else ()
    return Model(full.lexicon, {**excused, **(exceptions or {})}, curve)


def score(df: DataFrame, id_col: str, text_col: str, model: Model, threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted, hits) of every row.

    Only the text enters the score. A null or empty text is scored as a text
    without words; repeated rows come out alike; an empty table gives no rows.
    """
    lexicon, curve = model.lexicon, np.array(model.curve or (0.0, 0.0, 0.0, 0.0))

    def make():
        found = model.automaton() if lexicon else None

        def work(batch: pa.RecordBatch) -> list:
            rows, hits = [], []
            for text in pc.fill_null(batch.column(2).cast(pa.large_string()), "").to_pylist():
                words = fold(text)
                weights = matched(found, words)[1] if found and words else {}
                rows.append(features(weights, len(words)))
                hits.append(len(weights))
            p = 1 / (1 + np.exp(-np.clip(np.array(rows) @ curve, -30, 30))) if found else np.zeros(len(rows))
            return [batch.column(0), batch.column(1), p, (p >= threshold).astype(np.int32), hits]

        return work

    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    rows = df.select(quoted(id_col), held_out(quoted(id_col)).alias("held_out"), quoted(text_col))
    held, *names = fresh(df.select(quoted(id_col)), "held_out", "score", "predicted", "hits")
    schema = ", ".join(f"{n} {k}" for n, k in zip([held, *names], ("boolean", "double", "int", "int")))
    return map_batches(rows, make, f"{tick(id_col)} {kind}, {schema}")


def drop_toxic(df: DataFrame, text_col: str, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows of ``df`` that score below ``threshold``; columns stay as they are.

    A null or empty text counts as one without words; repeated rows fare alike; an empty table stays empty.
    """
    lexicon, curve, at = model.lexicon, np.array(model.curve or (0.0, 0.0, 0.0, 0.0)), df.columns.index(text_col)
    if not lexicon:
        return df

    def make():
        found = model.automaton()

        def work(batch: pa.RecordBatch) -> list:
            keep = []
            for text in batch.column(at).to_pylist():
                words = fold(text or "")
                z = float(np.dot(features(matched(found, words)[1], len(words)), curve))
                keep.append(1 / (1 + np.exp(-min(max(z, -30), 30))) < threshold)
            return batch.filter(pa.array(keep)).columns

        return work

    schema = ", ".join(f"{tick(f.name)} {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, make, schema)
