"""Value semantics that every profile depends on: white space, missing values, rounding, numbers, value kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case texts that stand for a missing value.
MISSING_TEXTS = ("", "-", "n/a", "null", "none", "unknown", "not available")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Formats that count as dates, in place of an engine-defined parser.
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def trim_ws(c: Column) -> Column:
    """Without any white space at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null, or a text that stands for a missing value.  NaN isn't missing."""
    return F.coalesce(F.lower(trim_ws(c.cast("string"))).isin(*MISSING_TEXTS), F.lit(True))


def js_round(c: Column, digits: int = 0) -> Column:
    """Half goes up, also below zero; Spark's round goes away from zero."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def to_number(c: Column) -> Column:
    """Finite number of a value or its text: white space around it, exponents and hex are fine; an empty text is 0."""
    text = trim_ws(c.cast("string"))
    plain = F.when(text.rlike(NUMBER), text.try_cast("double"))
    whole = F.conv(F.substring(text, 3, 64), 16, 10).try_cast("double")
    value = F.when(text == "", 0.0).when(text.rlike("^0[xX][0-9a-fA-F]+$"), whole).otherwise(plain)
    return F.when(F.abs(value) < float("inf"), value)


def finite(c: Column, kind: str) -> Column:
    """Finite numbers of a column: as they are if it is numeric, else coerced from its non-missing texts."""
    if kind == "numeric":
        return F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double"))
    return F.when(~is_missing(c), to_number(c))


def value_kind(c: Column) -> Column:
    """'numeric', 'date' or 'string' of a non-missing value, else null."""
    text = trim_ws(c.cast("string"))
    return F.when(is_missing(c), None).when(text.rlike(NUMBER), "numeric").when(text.rlike(DATE), "date").otherwise("string")
