"""Text to numbers, and what counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a CSV upload reads as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """The finite number that a text spells in decimal notation, or null."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(_DECIMAL), trimmed.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def known(text: Column) -> Column:
    """The text, or null where it is one of NA_TOKENS."""
    return F.when(~F.trim(text).isin(*NA_TOKENS), text)
