"""String column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() removes.  F.trim alone
# removes spaces only.
STRIP_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
               0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
               0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
STRIP_CHARS = "".join(map(chr, STRIP_CODES))
# SKU repair.  Letters misread in codes and what they stand
# for ("A" is "-", "Z" is "0"), the digit run kept, and the canonical prefix.
SKU_MISREAD_FROM = "AZ"
SKU_MISREAD_TO = "-0"
SKU_DIGITS = 4
SKU_PREFIX = "SKU-"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace like Python's ``str.strip()``."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def norm_key(c) -> Column:
    """Lower-case and strip: the lookup form of an entity spelling."""
    return F.lower(strip_ws(c))


def clean_sku(c, digits: int = SKU_DIGITS) -> Column:
    """Canonical SKU code.

    Upper-case and strip, read ``A`` as ``-`` and ``Z`` as ``0`` (the
    observed corruption), then keep the first run of ``digits`` digits behind
    the prefix.  Without one the repaired text is returned; NULL stays NULL
    (the fact join drops it later).
    """
    s = F.translate(F.upper(strip_ws(_col(c))), SKU_MISREAD_FROM, SKU_MISREAD_TO)
    # nullif searches the text once, a CASE would for test and value
    run = F.nullif(F.regexp_extract(s, rf"(\d{{{digits}}})", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit(SKU_PREFIX), run), s)


# The default year pattern, a stand-alone 20xx.
YEAR_PATTERN = r"\b(20\d{2})\b"


def extract_year(text, pattern: str = YEAR_PATTERN) -> Column:
    """First match of ``pattern``'s group 1 in a text as a BIGINT, else NULL."""
    y = F.regexp_extract(_col(text), pattern, 1)
    return F.when(y != "", y.cast("bigint"))


def typo(c, pos, letter) -> Column:
    """``c`` with the character at 1-based ``pos`` replaced by ``letter``."""
    pos = F.lit(pos) if isinstance(pos, int) else _col(pos)
    letter = F.lit(letter) if isinstance(letter, str) else _col(letter)
    return F.overlay(_col(c), letter, pos, F.lit(1))
