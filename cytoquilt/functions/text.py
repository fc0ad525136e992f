"""Text clean-up and matching as column expressions (all stay in the JVM)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoquilt.constants import MISSING_INTAKE, MISSING_LABELS_CASED, MISSING_RULES, MISSING_TISSUE, TRUTHY

# every character a text strip has to remove, not only the plain space
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c).cast("string"), F.lit(WHITESPACE))


def clean(c: Column | str, missing: Iterable[str] = MISSING_RULES) -> Column:
    """Stripped text, with NULL and missing-like words turned into ''."""
    text = strip(c)
    return F.coalesce(F.when(~F.lower(text).isin(*missing), text), F.lit(""))


def clean_intake(c: Column | str) -> Column:
    return clean(c, MISSING_INTAKE)


def blank_to_null(c: Column | str) -> Column:
    """Stripped text, '' turned into NULL; words such as 'nan' stay as they are."""
    return F.nullif(strip(c), F.lit(""))


def portable_label(c: Column | str) -> Column:
    """Label text where only the exact spellings nan, <NA> and None are blanked."""
    text = as_col(c).cast("string")
    return F.when(text.isNull() | text.isin(*MISSING_LABELS_CASED), F.lit("")).otherwise(text)


def clean_tissue(c: Column | str) -> Column:
    text = as_col(c).cast("string")
    return F.when(text.isNull() | F.lower(text).isin(*MISSING_TISSUE), F.lit("unknown")).otherwise(text)


def match_text(c: Column | str, joiners: str = "_/|+-") -> Column:
    """Lower-cased text with letters and digits split and separators as spaces.

    ``joiners`` are the separators; tissue matching keeps '+' and '-'.
    """
    inside = "".join("\\" + ch if ch in "-]^\\" else ch for ch in joiners)
    text = F.lower(clean(c))
    text = F.regexp_replace(text, "([a-z])([0-9])", "$1 $2")
    text = F.regexp_replace(text, "([0-9])([a-z])", "$1 $2")
    text = F.regexp_replace(text, f"[{inside}]+", " ")
    text = F.regexp_replace(text, r"[\(\)\[\],;:]+", " ")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return strip(text)


def match_text_tissue(c: Column | str) -> Column:
    return match_text(c, joiners="_/|")


def contains_any(c: Column | str, tokens: Sequence[str]) -> Column:
    """True where the cleaned text holds any token, ignoring case."""
    text = F.lower(clean(c))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(text, F.lit(token.lower()))
    return hit


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """True where any pattern is found, ignoring case; NULL counts as no match."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(as_col(c).cast("string").rlike(f"(?i)(?:{joined})"), F.lit(False))


def yes_no(c: Column | str) -> Column:
    text = F.lower(clean_intake(c))
    return (
        F.when(text.isin("yes", "y", "true", "1"), "yes").when(text.isin("no", "n", "false", "0"), "no").otherwise("")
    )


def is_truthy(c: Column | str, truthy: Sequence[str] = TRUTHY) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*truthy), F.lit(False))


def first_nonblank(*cols: Column | str) -> Column:
    """First non-blank cleaned value of each row, '' where all are blank."""
    return F.coalesce(*[F.nullif(clean_intake(c), F.lit("")) for c in cols], F.lit(""))


def prefer(left: Column | str, right: Column | str) -> Column:
    """Left text where not blank, else right."""
    return first_nonblank(left, right)


def slug(c: Column | str) -> Column:
    """Lower-case key with runs of other characters as one underscore."""
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))
