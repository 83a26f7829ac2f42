"""Scalar expressions with the edge cases settled: infinite, undefined and missing numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def guarded_ratio(x: Column, y: Column) -> Column:
    """x / y where y is above 0, else null."""
    return F.when(y > 0, x / F.when(y > 0, y))


def log2_ratio(a: Column, b: Column) -> Column:
    """log2(a / b) of positive numbers that may be infinite: both infinite gives 0."""
    up, down = a == INFINITE, b == INFINITE
    return F.when(up & down, 0.0).when(up, F.lit(INFINITE)).when(down, F.lit(-INFINITE)).otherwise(F.log2(a / b))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def at_least(x: Column, target: float, slack: float = 1e-12) -> Column:
    return x >= target - slack


def target_bits(bits: Column, k: int) -> Column:
    """The k lowest bits of a mask as booleans, lowest first."""
    return F.array(*[F.shiftrightunsigned(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1 for i in range(k)])


def condition_name(correlation: Column, s: Column) -> Column:
    return F.format_string("%s_s%.4f", correlation, s)


def hex64(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
