"""Label columns: weights, normalising, response parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftspan.functions.numeric import col

# The three labels and the weight of each in the beta index.
LABELS = ["E0", "E1", "E2"]
LABEL_WEIGHT = {"E0": 0.0, "E1": 1.0, "E2": 0.5}
TIE = "TIE"


def is_label(c: Column | str) -> Column:
    """Membership that is false, never null, for a missing label."""
    return F.coalesce(col(c).isin(LABELS), F.lit(False))


def label_weight(c: Column | str) -> Column:
    """Index weight of a label; null for anything that is not a label."""
    out = None
    for label in LABELS:
        hit = col(c) == label
        weight = F.lit(LABEL_WEIGHT[label])
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out


def clean_label(c: Column | str) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def parse_response(c: Column | str) -> Column:
    """Label on the last line of the form ``SCORE: <label>``; later lines with
    an unknown label are passed over; null when no line qualifies."""
    lines = F.transform(
        F.split(col(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
        lambda line: F.upper(F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")),
    )
    scores = F.filter(
        lines, lambda line: line.rlike(r"^SCORE:[\s\p{Z}]*E[012]$")
    )
    return F.substring(F.try_element_at(scores, F.lit(-1)), -2, 2)
