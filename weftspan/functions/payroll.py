"""Cell parsers of payroll release tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftspan.functions.numeric import col
from weftspan.functions.text import collapse
from weftspan.sources import fixed_values as V
from weftspan.sources.maps import recode

# Patterns of release tables.
FULL_MONTH = r"^([A-Za-z]+)[ ,]+(20\d\d)$"
SHORT_MONTH = r"^([A-Z][a-z]{2})-(\d{2}|20\d\d)$"
YEAR_BLOCK = r"^20\d\d-\d\d\b"
BAND_LINE = r"^(Less than 18|18-21|22-25|26-28|29-35|More than 35)\s+(.+)$"
SECTION_END = r"^2\.2\s"


def clean_cell(c: Column | str) -> Column:
    return collapse(F.coalesce(col(c), F.lit("")))


def parse_value(c: Column | str) -> Column:
    """Whole number with commas or blanks; a lone dash is 0; else null."""
    bare = F.regexp_replace(col(c), r"[,\s]", "")
    return F.when(bare.isin("-", "–"), F.lit(0).cast("bigint")).when(
        bare.rlike(r"^-?\d+$"), bare.try_cast("bigint")
    )


def parse_band(c: Column | str) -> Column:
    """One of the six age bands, or null."""
    bare = F.regexp_replace(clean_cell(c), r"^[A-F]\s*-\s*", "")
    return recode(F.lower(F.regexp_replace(bare, r"\s*-\s*", "-")), V.BAND_ALIASES)


def parse_gender(c: Column | str) -> Column:
    return recode(F.lower(F.regexp_replace(col(c), r"[\s-]", "")), V.GENDER_ALIASES)


def parse_measure(c: Column | str) -> Column:
    h = F.lower(col(c))
    return (
        F.when(F.contains(h, F.lit("rejoined")), F.lit("rejoined"))
        .when(F.contains(h, F.lit("ceased")) | F.contains(h, F.lit("exited")), F.lit("ceased"))
        .when(F.contains(h, F.lit("new epf")), F.lit("new_subscribers"))
    )


_FULL = {name: f"{i:02d}" for i, name in enumerate(V.MONTH_NAMES, 1)} | {
    typo: f"{i:02d}" for typo, i in V.MONTH_TYPOS.items()
}
_SHORT = {name[:3]: f"{i:02d}" for i, name in enumerate(V.MONTH_NAMES, 1)}


def full_month(c: Column | str) -> Column:
    """``April 2025`` to ``2025-04``; null for anything else."""
    text = clean_cell(c)
    number = recode(F.lower(F.regexp_extract(text, FULL_MONTH, 1)), _FULL)
    year = F.regexp_extract(text, FULL_MONTH, 2)
    return F.when(number.isNotNull(), F.concat(year, F.lit("-"), number))


def short_month(c: Column | str) -> Column:
    """``Apr-25`` to ``2025-04`` if within the range of known months."""
    text = clean_cell(c)
    number = recode(F.lower(F.regexp_extract(text, SHORT_MONTH, 1)), _SHORT)
    year = F.regexp_extract(text, SHORT_MONTH, 2)
    full_year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    month = F.concat(full_year, F.lit("-"), number)
    return F.when(number.isNotNull() & month.between(*V.MONTH_RANGE), month)
