"""Rounding that agrees with the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_1(x: Column) -> Column:
    """x to one decimal, ties by the exact value of the double and then to even.

    20x rounded is odd near a tie; the rest 20x - n, computed without error,
    says on which side x lies.
    """
    n = F.rint(x * 20)
    rest = (x * 16 - n) + x * 4
    odd = F.abs(n % 2) == 1
    return F.when(odd & (F.abs(rest) < 1e-9) & (rest != 0), (n + F.signum(rest)) / 20).otherwise(F.rint(x * 10) / 10)
