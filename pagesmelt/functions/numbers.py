"""Rounding by the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(column: str, digits: int) -> Column:
    """Round a non-negative double column to ``digits``, ties of its exact value to even.

    ``round`` works on the shortest decimal text of a double, so 2.675 becomes 2.68 although the
    number is a little less.  Splitting the double in two halves makes the scaling exact.
    """
    scale = f"{10 ** digits}D"
    high = f"(134217729D * {column} - (134217729D * {column} - {column}))"
    scaled = f"({high} * {scale} + ({column} - {high}) * {scale})"
    below = f"floor({scaled})"
    # Signed distance from the tie; the half comes off before the small part is added.
    over = f"(({high} * {scale} - {below} - 0.5D) + ({column} - {high}) * {scale})"
    return F.expr(
        f"({below} + CASE WHEN {over} > 0 OR ({over} = 0 AND {below} % 2 = 1) "
        f"THEN 1 ELSE 0 END) / {scale}")
