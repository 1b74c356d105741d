"""White space and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesmelt.fixed_values import UNICODE_SPACE

# The same characters as a SQL string literal; none of them needs escaping there.
SPACE_SQL = f"'{UNICODE_SPACE}'"


def text_trim(column: Column) -> Column:
    """Trim Unicode white space, not only the space character ``trim`` removes."""
    return F.btrim(column, F.lit(UNICODE_SPACE))


def collapse_space(column: Column) -> Column:
    """Trim, and turn every inner run of Unicode white space into one space."""
    return text_trim(F.regexp_replace(column, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))


def class_tokens(attrs: Column) -> Column:
    """The tokens of a ``class`` attribute, empty when there is none."""
    return F.filter(
        F.split(F.coalesce(attrs["class"], F.lit("")), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"),
        lambda token: token != "")
