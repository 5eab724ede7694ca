"""Guide labels: parsing, the control label, composite keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The leading "letters-or-digits dot digits" part names the guide; "0" names the control.
GUIDE_PATTERN = r"(?U)^\p{Alnum}+\.\p{Digit}+"
CONTROL = "0"


def parse_guide(label: Column) -> Column:
    """Leading ``name.digits`` part of a label, null when the label has none."""
    return F.regexp_substr(label, F.lit(GUIDE_PATTERN))


def default_control(guide: Column, control: str = CONTROL) -> Column:
    return F.coalesce(guide, F.lit(control))


def is_wild_type(guide: Column, control: str = CONTROL) -> Column:
    return guide == F.lit(control)


def cluster_guide_key(louvain: Column, guide: Column) -> Column:
    return F.concat_ws("-", louvain.cast("string"), guide)
