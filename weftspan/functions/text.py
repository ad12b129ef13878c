"""Text column helpers for description parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftspan.functions.numeric import col

# Patterns of the source documents.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
CODE = r"\b(\d{4}\.\d{4})\b"
FURNITURE_LINE = (
    r"^(VOLUME II ?[AB]|National Classification of Occupations.*|Division \d+|\d{1,3})\s*$"
)
FURNITURE_INLINE = [
    r"VOLUME II ?[AB](\s+\d{1,3})?",
    r"National Classification of Occupations\s*[–-]\s*2015(\s+Division \d)?",
]
TAIL_SECTIONS = [
    r"(?s)ISCO\s*08\s*Unit\s*Group\s*Details.*",
    r"(?s)Qualification\s*Pack\s*Details.*",
]
SENTENCE_END = r"(?<=[.;])\s+(?=[A-Z])"
DESIGNATION = r"(?i)\b(is designated|may be designated|may specialise|may specialize)\b"
MIN_DESCRIPTION = 40
MIN_STATEMENT = 15
SHORT_STATEMENT = 40


def strip(c: Column | str) -> Column:
    """Strip every kind of white space on both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(col(c), rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), rf"{SPACE}+", " "))


def rejoin_hyphens(c: Column | str) -> Column:
    """Undo line-break splits around a hyphen: ``stand -by`` to ``stand-by``."""
    first = F.regexp_replace(col(c), rf"({WORD}){SPACE}+-{SPACE}*({WORD})", "$1-$2")
    return F.regexp_replace(first, rf"({WORD}){SPACE}*-{SPACE}+({WORD})", "$1-$2")


def clean_text(c: Column | str) -> Column:
    out = col(c)
    for pattern in FURNITURE_INLINE:
        out = F.regexp_replace(out, pattern, " ")
    return collapse(rejoin_hyphens(out))


def cut_tails(c: Column | str) -> Column:
    out = col(c)
    for pattern in TAIL_SECTIONS:
        out = F.regexp_replace(out, pattern, "")
    return out


def is_furniture(c: Column | str) -> Column:
    return strip(c).rlike(FURNITURE_LINE)


def words(c: Column | str) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[,;]+|[,;]+$", "")


def rstrip_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[,;]+$", "")


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)
