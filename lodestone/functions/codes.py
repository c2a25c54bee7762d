"""Codes of numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 9  # bytes of seven bits that a 63-bit number takes at most


def uleb128(n: Column) -> Column:
    """A number from 0 on as bytes of seven bits, the lowest first, each but the last with its high bit set; in hexadecimal."""

    def byte(i: int) -> Column:
        value = F.shiftright(n, 7 * i).bitwiseAND(F.lit(127).cast("long"))
        more = F.shiftright(n, 7 * (i + 1)) > 0 if i < PLACES - 1 else F.lit(False)
        return F.lpad(F.lower(F.hex(value + F.when(more, 128).otherwise(0))), 2, "0")

    return F.concat(byte(0), *[F.when(F.shiftright(n, 7 * i) > 0, byte(i)).otherwise("") for i in range(1, PLACES)])


def from_uleb128(code: Column) -> Column:
    """The number that such bytes stand for."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(code) / 2).cast("int") - 1), lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long")))
    return F.aggregate(F.reverse(parts), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b)
