"""Rounding as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column, digits: int) -> Column:
    """Round the exact value of a non-negative double, ties to even.

    ``bround`` rounds the shortest decimal text of the double, so it takes 2.45
    (stored a little above) for a tie. Here the distance to the tie is computed
    without error: the double is split in two halves, whose products with a
    power of ten are exact.
    """
    x = col.cast("double")
    scale = float(10 ** digits)
    split = x * 134217729.0                 # 2**27 + 1
    high = split - (split - x)
    low = x - high
    whole = F.floor(x * scale).cast("double")
    over = (high * scale - (whole + 0.5)) + low * scale
    odd = (whole % 2) == 1
    up = F.when((over > 0) | ((over == 0) & odd), whole + 1).otherwise(whole)
    return up / scale


def round_half_up(col: Column) -> Column:
    """Nearest integer, a half goes up (also below zero)."""
    return F.floor(col + F.lit(0.5))
