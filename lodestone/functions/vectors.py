"""Vector functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """A vector of length 1 in the same direction; null for one without a direction. Of unit vectors, dot is the cosine."""
    scaled = lambda size: F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))  # the length is bound once, not worked out for each element


def surprise(similarity: Column) -> Column:
    """0 for what the context says already, 1 for its opposite, 0.5 without a context."""
    return F.coalesce((1.0 - similarity) / 2.0, F.lit(0.5))


def quantized(a: Column, bits: int = 3) -> Column:
    """Each number as one of 2^bits levels between the vector's least and greatest."""
    levels = float((1 << bits) - 1)
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(high > low, F.floor((x - low).cast("double") / (high - low).cast("double") * levels + 0.5)).otherwise(0).cast("int"))


def encoded(vector: Column, scale: Column) -> Column:
    """A vector's elements in steps of scale, from -127 to 127, as a byte each in hexadecimal."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex((F.rint(x / scale) + 128).cast("long"))), 2, "0")), "")


def decoded_steps(code: Column) -> Column:
    """The steps that a code stands for."""
    places = F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))
    return F.transform(places, lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") - 128)
