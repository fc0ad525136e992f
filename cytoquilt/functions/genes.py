"""Gene-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoquilt.constants import (
    NONCODING_CLONE,
    NONCODING_PREFIXES,
    NONCODING_SUBSTRINGS,
    RIBOSOMAL_PREFIXES,
)
from cytoquilt.functions.text import as_col, strip


def canonical_symbol(c: Column | str) -> Column:
    """Upper-case symbol without a genome prefix such as ``GRCh38_`` or ``hg19-``."""
    return F.regexp_replace(F.upper(strip(c)), r"^(GRCH|HG|MM|GRCM)\d+[_:-]+", "")


def canonical_symbol_py(name: str) -> str:
    """The same rule for names known on the driver (panel constants)."""
    import re

    return re.sub(r"^(GRCH|HG|MM|GRCM)\d+[_:-]+", "", name.strip().upper())


def is_mitochondrial(c: Column | str, ignore_case: bool = False) -> Column:
    text = as_col(c)
    return (F.upper(text) if ignore_case else text).startswith("MT-")


def variable_gene_flags(c: Column | str) -> dict[str, Column]:
    """Flags for genes kept out of variable-gene selection, and the joined reason."""
    upper = F.upper(as_col(c))
    mito = upper.startswith("MT-")
    ribo = upper.rlike("^(?:" + "|".join(RIBOSOMAL_PREFIXES) + ")")
    noncoding = upper.rlike("^(?:" + "|".join(NONCODING_PREFIXES) + ")") | upper.rlike(NONCODING_CLONE)
    reason = F.concat_ws(
        ",",
        F.when(mito, "mitochondrial"),
        F.when(ribo, "ribosomal"),
        F.when(noncoding, "noncoding_like"),
    )
    return {
        "exclude_from_hvg": mito | ribo | noncoding,
        "exclude_mitochondrial": mito,
        "exclude_ribosomal": ribo,
        "exclude_noncoding_like": noncoding,
        "exclude_reason": reason,
    }


def is_noncoding_name(c: Column | str) -> Column:
    """True where the name contains one of the noncoding words anywhere."""
    return F.upper(as_col(c)).rlike("|".join(NONCODING_SUBSTRINGS))
