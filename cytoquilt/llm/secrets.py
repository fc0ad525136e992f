"""Secret scans over a trigram inverted index (operator 4), with built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived
that every match must satisfy. The index has a posting (trigram, text) for each
trigram that some query names; intersecting postings gives each rule its
candidate texts, on which the expression itself is then run. A rule without a
mandatory trigram is run on every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, quoted, row_key
from cytoquilt.llm.spans import Kind, add_spans

Query = bool | str | tuple  # True: no demand; a trigram; ("and" | "or", queries)

#: The assignment, access-key and hex rules of the base, then public formats of tokens.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_LONG = r"[A-Za-z0-9+/_.=-]{12,}$"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``keep`` is an expression that a match has to fit as well."""

    name: str
    pattern: str
    keep: str | None = None


RULES = (
    Rule("assign", ASSIGN, r"^[^:=]*[:=]\x20*[\"']?" + ASSIGN_LONG),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{18,}$"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,16}://[^\s/:@]{1,128}:[^\s/:@]{1,128}@"),
)
BASE = ("assign", "access", "hex")


# ---- from expressions to trigrams
def both(kind: str, parts: Sequence[Query]) -> Query:
    """AND or OR with True folded away, and alternatives that demand more than another left out."""
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    if kind == "or":
        demands = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
        parts = [p for i, p in enumerate(parts) if not any(d < demands[i] for j, d in enumerate(demands) if j != i)]
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def of_strings(strings: set[str]) -> Query:
    """Any text that holds one of ``strings`` satisfies this."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def letters(items: Sequence, most: int = 8) -> set[str] | None:
    """The lower-cased members of a character class, None for more than ``most``."""
    from re import _constants as c

    out: set[str] = set()
    for op, value in items:
        if op is c.LITERAL:
            out.add(chr(value).lower())
        elif op is c.RANGE and value[1] - value[0] < 64:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= most else None


def analysed(items: Sequence) -> tuple[set[str] | None, Query]:
    """(all strings matched, if few; what every match demands)."""
    from re import _constants as c

    run, demands, exact = {""}, [], True

    def flush() -> None:
        nonlocal run
        demands.append(of_strings(run))
        run = {""}

    for op, value in items:
        few, demand = None, True
        if op is c.LITERAL:
            few = {chr(value).lower()}
        elif op is c.IN:
            few = letters(value)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            few = {""}
        elif op is c.SUBPATTERN:
            few, demand = analysed(value[-1])
        elif op is c.BRANCH:
            ways = [analysed(w) for w in value[1]]
            few = set().union(*[w[0] for w in ways]) if all(w[0] is not None for w in ways) else None
            demand = both("or", [w[1] for w in ways])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, body = value
            inner, asked = analysed(body)
            if (low, high) == (0, 1) and inner is not None:
                few = inner | {""}
            elif low == high == 1:
                few, demand = inner, asked
            elif low >= 1:
                demand = asked
        if few is not None and len(few) * len(run) <= 256:
            run = {a + b for a in run for b in few}
            continue
        flush()
        exact = False
        demands.append(of_strings(few) if few is not None else demand)
    if exact:
        return run, of_strings(run)
    flush()
    return None, both("and", demands)


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-cased trigrams that every match of ``pattern`` satisfies; True if there is none."""
    from re import _parser

    return analysed(_parser.parse(pattern))[1]


def trigrams_in(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams_in, query[1])) if isinstance(query, tuple) else set()


# ---- index, candidates, verification
def postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index over ``trigrams``: one row (trigram number, _a, _b) for each text that has it. ``texts`` has _a, _b, _text."""
    low = texts.select("_a", "_b", F.lower("_text").alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("_a", "_b", F.explode(present).alias("_trigram"))


def candidates(index: DataFrame, trigrams: Sequence[str], queries: dict[str, Query]) -> DataFrame:
    """(_a, _b, _rules): which rules' queries a text satisfies. Postings meet by text, as bits, summed before the shuffle."""
    words = -(-len(trigrams) // 62)
    bit = F.expr("shiftleft(1L, _trigram % 62)")
    masks = [F.bit_or(F.when(F.floor(F.col("_trigram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(words)]
    met = index.groupBy("_a", "_b").agg(*masks)
    number = {t: i for i, t in enumerate(trigrams)}

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            return F.col(f"_w{number[q] // 62}").bitwiseAND(F.lit(1 << number[q] % 62)) != 0
        parts = [holds(p) for p in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(name)) for name, q in queries.items()]))
    return met.select("_a", "_b", rules.alias("_rules")).where(F.size("_rules") > 0)


def find_secrets(df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule] = RULES, name: str = "spans") -> DataFrame:
    """``df`` with ``name``: array<struct<start, kind_no, end, kind, hit>>, ordered by start and then rule.

    Per rule the leftmost non-overlapping matches, in code points. A null or empty
    text has none; every row stays, repeated rows come out alike; rows of an empty
    table are none.
    """
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    trigrams = sorted(set().union(*map(trigrams_in, queries.values()))) if queries else []
    a, b, hit = fresh(df, "_a", "_b", "_rules")
    own = [quoted(c) for c in df.columns]
    key = row_key(quoted(id_col), quoted(text_col))
    keyed = df.select(*own, key["a"].alias(a), key["b"].alias(b))
    if queries:
        texts = df.select(key["a"].alias("_a"), key["b"].alias("_b"), quoted(text_col).alias("_text"))
        found = candidates(postings(texts, trigrams), trigrams, queries)
        found = found.select(F.col("_a").alias(a), F.col("_b").alias(b), F.col("_rules").alias(hit))
        keyed = keyed.join(found, [a, b], "left")
    else:
        keyed = keyed.withColumn(hit, F.lit(None).cast("array<string>"))
    kinds = [Kind(r.name, r.pattern, (lambda h, k=r.keep: h.rlike(k)) if r.keep else None) for r in rules]

    def active(k: Kind) -> Column:
        return F.coalesce(F.array_contains(quoted(hit), k.name), F.lit(False)) if k.name in queries else F.lit(True)

    return add_spans(keyed, text_col, kinds, name, active).select(*own, quoted(name))
