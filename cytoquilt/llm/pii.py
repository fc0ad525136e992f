"""Personal data, and the terms that give it away (operator 5), with built-in functions only.

Addresses and numbers are found by pattern. Information-theoretic sanitisation
then looks at the words of the texts that hold them: with N distinct texts, a
term t that shares n(t, e) of them with an entity e, occurs in n(t), and e in n(e),

    PMI(t, e) = log2(N * n(t, e) / (n(t) * n(e))),   IC(e) = log2(N / n(e)).

A term tells so much of e as PMI / IC. From ``generalise`` on it is put in more
general words (its shape), from ``remove`` on it goes, unless chance alone would
often bring the two together that often. All counts are over all
documents, exact copies counted once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, quoted, row_key
from cytoquilt.llm.spans import Kind, add_spans, held
from cytoquilt.session import materialize


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check digit of a digit string: every second digit from the right is doubled."""
    each = F.transform(
        F.split(F.reverse(number), "(?<=[0-9])(?=[0-9])", -1),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def card(hit: Column) -> Column:
    number = digits(hit)
    return F.length(number).between(12, 19) & luhn(F.substring(number, 1, 19))


def address(hit: Column) -> Column:
    """Four parts of at most 255, leading zeros allowed."""
    return ~F.exists(F.split(F.regexp_replace(hit, r"(?<![0-9])0+(?=[0-9])", ""), r"\.", -1), lambda p: (F.length(p) > 3) | (p.cast("int") > 255))


#: The patterns of the base kinds. Possessive where that changes nothing, so that long runs stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = (
    Kind("email", EMAIL, None, lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", IP, address, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Kind("card", CARD, card, lambda t: t.rlike(r"[0-9][0-9 -]{10}")),
    Kind("phone", PHONE, lambda h: F.length(digits(h)).between(9, 15), lambda t: F.contains(t, F.lit("+"))),
)
BASE = tuple(k.name for k in KINDS)
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Distinct lower-cased words of three letters or digits and more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) >= 3))


SLOT_BITS = 22  # 512 KB of bitmap, however many keys there are


def marked(rows: DataFrame, a: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: true for every row whose key ``a`` is among ``_a`` of ``keys``, and for few others.

    The bitmap has a fixed size, so it may be broadcast. It only sorts out what
    needs no shuffle; what is marked is still joined or grouped exactly.
    """
    part, at, bits, right = fresh(rows, "_part", "_at", "_bits", "_right")

    def placed(df: DataFrame, key: str) -> DataFrame:
        slot = f"pmod(`{key}`, {1 << SLOT_BITS}L) + 1"
        return df.withColumns({part: F.expr(f"bitmap_bucket_number({slot})"), at: F.expr(f"bitmap_bit_position({slot})")})

    marks = placed(keys.select("_a"), "_a").groupBy(F.col(part).alias(right)).agg(F.expr(f"bitmap_construct_agg({at})").alias(bits))
    bit = F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1")
    joined = placed(rows, a).join(F.broadcast(materialize(marks)), F.col(part) == F.col(right), "left")
    return joined.select(*[quoted(c) for c in rows.columns], (F.coalesce(bit, F.lit(0)) == 1).alias(name))


def term_counts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(_term, _nt): in how many distinct texts a word occurs. Only texts that come twice are shuffled, words are summed in the task first."""
    rows = marked(rows, "_a", keys.where("_n > 1"), "_twice")
    once = rows.where("_twice").groupBy("_a", "_b").agg(F.first("_text").alias("_text")).select("_text")
    every = rows.where("not _twice").select("_text").unionByName(once).select(F.explode(words(F.col("_text"))).alias("_term"))
    return every.groupBy("_term").agg(F.count(F.lit(1)).alias("_nt"))


def evidence(n: Column, both: Column, n_term: Column, n_entity: Column) -> Column:
    """-ln of a bound (Chernoff's) on the chance that so many of the entity's texts have the term if the two are independent.

    For an entity of one text the bound is the chance itself, n(t) / N.
    """
    q, p = both / n_entity, n_term / n
    rest = (n_entity - both) * (F.log(1 - q) - F.log(1 - p))
    return both * (F.log(q) - F.log(p)) + F.when(both < n_entity, rest).otherwise(0.0)


def disclosing(rows: DataFrame, held: DataFrame, generalise: float, remove: float, significance: float) -> DataFrame:
    """(_a, _b, _terms array<struct<term, removed>>) of each text, by key, that holds an entity and a term that discloses it.

    ``rows`` holds _a and _b, the key of the text, and _text of all rows; ``held``
    _a, _b, _words and _entities of those with base spans.
    """
    keys = materialize(rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")))
    n = F.lit(float(keys.count()))
    held = materialize(held.dropDuplicates(["_a", "_b"]))
    entities = held.select("_a", "_b", F.explode("_entities").alias("_entity"))
    # entities of the very same texts have the same counts with every term and are taken as one: its key is made of those of the texts
    sets = materialize(entities.groupBy("_entity").agg(F.count(F.lit(1)).alias("_ne"), F.bit_xor("_a").alias("_xa"), F.bit_xor("_b").alias("_xb")))
    member = entities.join(sets, "_entity").select("_a", "_b", "_xa", "_xb", "_ne").distinct()

    def most(n_entity: Column) -> Column:
        """Largest n(t) with which a term can reach ``generalise``, since n(t, e) <= n(e); a hair more for rounding."""
        return F.pow(n, F.lit(1 - generalise)) * F.pow(n_entity, F.lit(generalise)) * 1.000001

    top = float(sets.agg(F.max("_ne")).first()[0] or 0)
    rare = term_counts(rows, keys).where(F.col("_nt") <= most(F.lit(top)))
    placed = held.select("_a", "_b", F.explode("_words").alias("_term")).join(rare, "_term")
    seen = materialize(placed.join(member, ["_a", "_b"]).where(F.col("_nt") <= most(F.col("_ne"))))
    pmi = F.log2(n * F.col("_both") / (F.col("_nt") * F.col("_ne")))
    content = F.log2(n / F.col("_ne"))
    pairs = seen.groupBy("_xa", "_xb", "_ne", "_term", "_nt").agg(F.count(F.lit(1)).alias("_both"))
    pairs = pairs.where(evidence(n, F.col("_both"), F.col("_nt"), F.col("_ne")) >= -math.log(significance))
    told = pairs.select("_xa", "_xb", "_ne", "_term", F.when(content > 0, pmi / content).otherwise(0.0).alias("_share"))
    told = seen.join(told.where(F.col("_share") >= generalise), ["_xa", "_xb", "_ne", "_term"])
    told = told.groupBy("_a", "_b", "_term").agg(F.max("_share").alias("_share"))
    one = F.struct(F.col("_term").alias("term"), (F.col("_share") >= remove).alias("removed"))
    return told.groupBy("_a", "_b").agg(F.collect_list(one).alias("_terms"))


def find_pii(
    df: DataFrame, id_col: str, text_col: str, generalise: float = 0.7, remove: float = 0.9,
    significance: float = 0.05, spans: str = "spans", terms: str = "terms",
) -> DataFrame:
    """``df`` with ``spans`` (base kinds and "term", ordered by start) and ``terms`` array<struct<term, removed>>.

    Spans are in code points. A term span is an occurrence, outside base spans, of
    a word that discloses an entity of the same text, however far off. Entities of
    a single text take part; what the two share must be unlikely by chance, at
    ``significance``, which only matters among few texts (see ``evidence``). A null or empty text has no spans; every row and column stays,
    repeated rows come out alike; an empty table comes out empty.
    """
    base, a, b, told, some = fresh(df, "_base", "_ka", "_kb", "_told", "_some")
    own = [quoted(c) for c in df.columns]
    text = quoted(text_col)
    key = row_key(text)
    own_key = [key["a"].alias("_a"), key["b"].alias("_b")]
    entity = F.transform(quoted(base), lambda s: F.xxhash64(s["kind"], s["hit"]))
    held = add_spans(df, text_col, KINDS, base).where(F.size(quoted(base)) > 0)
    held = held.select(*own_key, words(text).alias("_words"), F.array_distinct(entity).alias("_entities"))
    rows = df.select(*own_key, F.coalesce(text, F.lit("")).alias("_text"))
    flagged = materialize(disclosing(rows, held, generalise, remove, significance))
    placed = materialize(term_spans(rows, flagged))
    # the base spans are found again rather than shuffled along with all texts; texts without terms are not shuffled
    keyed = marked(df.select(*own, key["a"].alias(a), key["b"].alias(b)), a, placed, some)
    placed = placed.select(F.col("_a").alias(a), F.col("_b").alias(b), F.struct("_terms", "_spans").alias(told))
    joined = keyed.where(quoted(some)).join(placed, [a, b], "left").select(*own, quoted(told))
    plain = keyed.where(~quoted(some)).select(*own, F.lit(None).cast(placed.schema[told].dataType).alias(told))
    found = add_spans(plain.union(joined), text_col, KINDS, base)
    merged = F.when(quoted(told).isNull(), quoted(base)).otherwise(F.array_sort(F.concat(quoted(base), quoted(told)["_spans"])))
    empty = F.array().cast("array<struct<term:string,removed:boolean>>")
    return found.select(*own, merged.alias(spans), F.coalesce(quoted(told)["_terms"], empty).alias(terms))


SPAN = "struct<start:int,kind_no:int,end:int,kind:string,hit:string>"


def term_spans(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """(_a, _b, _terms, _spans) of each text with terms: where they occur outside base spans, as spans of kind "term".

    Words, terms and base spans of a text meet by joins on word and place, so
    a text with very many of all three stays linear.
    """
    texts = marked(rows, "_a", flagged, "_some").where("_some").groupBy("_a", "_b").agg(F.first("_text").alias("_text"))
    texts = materialize(texts.join(flagged.select("_a", "_b"), ["_a", "_b"], "left_semi"))
    words_in = add_spans(texts, "_text", [Kind("term", WORD)], "_words").select("_a", "_b", F.explode("_words").alias("_s"))
    words_in = words_in.withColumn("_term", F.lower("_s.hit"))
    asked = flagged.select("_a", "_b", F.explode("_terms.term").alias("_term"))
    # all words are laid out once; few of them are terms
    hits = materialize(words_in.join(asked, ["_a", "_b", "_term"], "left_semi").select("_a", "_b", "_s"))

    def cells(df: DataFrame) -> DataFrame:
        """Each span once for every stretch of 64 characters it lies in."""
        return df.withColumn("_cell", F.explode(F.sequence(F.expr("_s.start div 64"), F.expr("(_s.end - 1) div 64"))))

    taken = add_spans(texts, "_text", KINDS, "_base").select("_a", "_b", F.explode("_base").alias("_s"))
    taken = cells(taken).select("_a", "_b", "_cell", F.col("_s.start").alias("_from"), F.col("_s.end").alias("_to"))
    over = cells(hits).join(taken, ["_a", "_b", "_cell"]).where("_from < _s.end and _s.start < _to").select("_a", "_b", "_s.start").distinct()
    free = hits.withColumn("start", F.col("_s.start")).join(over, ["_a", "_b", "start"], "left_anti")
    own = free.groupBy("_a", "_b").agg(F.collect_list(F.col("_s").withField("kind_no", F.lit(len(KINDS)))).alias("_spans"))
    found = flagged.join(own, ["_a", "_b"], "left")
    return found.select("_a", "_b", "_terms", F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>").alias("_spans"))


def shape(word: Column) -> Column:
    """A word in general terms: [WORD], or [NUMBER] where it holds a digit."""
    return F.when(word.rlike(r"\p{N}"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))


def sanitise(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``df`` with personal data and disclosing terms taken out of ``text_col``; rows and columns stay.

    Overlapping matches of several kinds are one stretch, which becomes, as a
    whole, the name in brackets of its first kind (by start, then in the order
    email, ip, card, phone); disclosing terms become their shape or go. Null stays
    null; other cases as in ``find_pii``.
    """
    spans, terms, gone, parts = fresh(df, "_spans", "_terms", "_gone", "_parts")
    out = find_pii(df, id_col, text_col, spans=spans, terms=terms, **options)
    own = [quoted(c) for c in df.columns]
    text = quoted(text_col)
    removed = F.transform(F.filter(quoted(terms), lambda t: t["removed"]), lambda t: t["term"])
    out = held(out, [*own, quoted(spans)], gone, removed)

    def label(s: Column) -> Column:
        kept = F.when(F.array_contains(quoted(gone), F.lower(s["hit"])), F.lit("")).otherwise(shape(s["hit"]))
        return F.when(s["kind"] == "term", kept).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def stretch(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))

    def joined(done: Column, s: Column) -> Column:
        """Spans come by start: one that begins before the last stretch ends makes it longer."""
        last = F.element_at(done, -1)
        longer = last.withField("end", F.greatest(last["end"], s["end"]))
        return F.when(
            (F.size(done) > 0) & (s["start"] < F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(-1))),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)),
        ).otherwise(F.concat(done, F.array(s)))

    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    whole = F.aggregate(F.transform(quoted(spans), stretch), none, joined)
    some = F.size(quoted(spans)) > 0
    # one pass over the letters, so that the work grows with the text and not with text times stretches
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    out = held(out, own, parts, F.when(some, F.struct(whole.alias("cuts"), letters.alias("letters"))))
    cuts, each = quoted(parts)["cuts"], quoted(parts)["letters"]

    def piece(cut: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)))
        return F.concat(F.array_join(F.slice(each, start + 1, cut["start"] - start), ""), cut["label"])

    tail = F.element_at(cuts, -1)["end"]
    clean = F.concat(F.array_join(F.transform(cuts, piece), ""), F.array_join(F.slice(each, tail + 1, F.size(each)), ""))
    return out.select(*[F.coalesce(clean, text).alias(text_col) if c == text_col else quoted(c) for c in df.columns])
