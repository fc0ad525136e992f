"""Cell-barcode, key and receptor-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoquilt.functions.text import as_col, blank_to_null, clean, clean_intake, strip


def barcode_core(c: Column | str, cleaned: bool = False) -> Column:
    """Sequence before the lane suffix: ``AAAC-1`` and ``lib:aaac-1-0`` give ``AAAC``.

    ``cleaned`` says that missing-like text was blanked before.
    """
    text = F.upper(as_col(c) if cleaned else clean_intake(c))
    at_end = F.nullif(F.regexp_extract(text, r"([ACGTN]+)-\d+$", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(text, r"([ACGTN]+)-\d+", 1), F.lit(""))
    return F.coalesce(at_end, anywhere, F.substring_index(text, "-", 1))


def full_barcode(c: Column | str) -> Column:
    """Barcode with its lane suffix where there is one, else the cleaned text."""
    text = clean_intake(c)
    hit = F.regexp_extract(text, r"(?i)([ACGTN]+-\d+)", 1)
    return F.coalesce(F.nullif(F.upper(hit), F.lit("")), text)


def stripped_core(c: Column | str) -> Column:
    """Barcode letters after dropping numeric tails; other characters go."""
    text = F.coalesce(blank_to_null(c), F.lit(""))
    for pattern in (r"-\d+$", r"_\d+$", "[^ACGTN]"):
        text = F.regexp_replace(text, pattern, "")
    return text


def barcode_from_name(c: Column | str) -> Column:
    """Last ``_`` token of the last ``__`` token of a cell name."""
    return F.substring_index(F.substring_index(as_col(c), "__", -1), "_", -1)


def aligned_barcode(c: Column | str) -> Column:
    """First ``_`` token, less one numeric tail where two or more dashes are there."""
    text = strip(c)
    token = F.substring_index(text, "_", 1)
    short = F.regexp_replace(token, r"^(.*-.*)-[0-9]+$", "$1")
    return F.when(text.isNull() | F.lower(text).isin("", "nan"), F.lit("")).otherwise(short)


def alignment_key(barcode: Column | str, sample: Column | str | None = None) -> Column:
    sample_text = F.lit("") if sample is None else F.coalesce(as_col(sample).cast("string"), F.lit(""))
    return F.concat(aligned_barcode(barcode), F.lit("__"), sample_text)


def metadata_key(dataset: Column | str, original_id: Column | str, barcode: Column | str) -> Column:
    """``dataset||cell``; '' where either part is blank."""
    cell = F.coalesce(F.nullif(clean(original_id), F.lit("")), clean(barcode))
    gse = clean(dataset)
    return F.when((gse == "") | (cell == ""), F.lit("")).otherwise(F.concat(gse, F.lit("||"), cell))


def global_cell_id(dataset: Column | str, cell: Column | str) -> Column:
    return F.concat(as_col(dataset).cast("string"), F.lit("__"), as_col(cell).cast("string"))


def library_cell_id(library: Column | str, sample: Column | str, barcode: Column | str) -> Column:
    """``library:barcode``, the sample standing in for a blank library."""
    prefix = F.coalesce(F.nullif(clean_intake(library), F.lit("")), clean_intake(sample))
    return F.when(prefix == "", clean_intake(barcode)).otherwise(
        F.concat(prefix, F.lit(":"), clean_intake(barcode))
    )


def joined_key(*parts: Column | str) -> Column:
    return F.concat_ws("||", *[F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts])


def cdr3_of_chain(c: Column | str, chain: str) -> Column:
    """First non-empty value of ``chain`` in text such as ``TRB:x;TRA:y``."""
    tokens = F.split(clean_intake(c), ";")
    is_chain = lambda t: (
        F.contains(t, F.lit(":"))
        & (F.upper(strip(F.substring_index(t, ":", 1))) == chain)
        & (strip(_after_colon(t)) != "")
    )
    return F.coalesce(strip(_after_colon(F.get(F.filter(tokens, is_chain), F.lit(0)))), F.lit(""))


def _after_colon(t: Column) -> Column:
    return F.regexp_replace(t, "^[^:]*:", "")


def short_patient(c: Column | str) -> Column:
    """``P001`` becomes ``P1``; anything else is upper-cased as it is."""
    text = F.upper(clean_intake(c))
    digits = F.regexp_extract(text, r"^P0*([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("P"), digits)).otherwise(text)


def timepoint_sample(patient: Column | str, condition: Column | str, title: Column | str) -> Column:
    """Sample name ``P1.pre`` or ``P1.post.2`` from patient, condition and title."""
    who = short_patient(patient)
    low_title = F.lower(clean_intake(title))
    post = F.contains(F.lower(clean_intake(condition)), F.lit("post")) | F.contains(low_title, F.lit(".post."))
    number = F.regexp_replace(F.regexp_extract(low_title, r"\.post\.(\d+)$", 1), r"^0+(?=\d)", "")
    suffix = F.coalesce(F.nullif(number, F.lit("")), F.lit("1"))
    return F.when(who == "", F.lit("")).when(post, F.concat(who, F.lit(".post."), suffix)).otherwise(
        F.concat(who, F.lit(".pre"))
    )
