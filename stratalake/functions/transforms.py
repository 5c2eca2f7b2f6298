"""Partition transforms as columns: identity, void, truncate, bucket, year, month, day and hour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = 0xFFFFFFFF


def identity(c: Column) -> Column:
    return c


def void(c: Column, kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def truncate(c: Column, width: int, kind: T.DataType) -> Column:
    """The first characters or bytes, or the largest multiple of the width that is no larger."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.substring(c, 1, width)
    if isinstance(kind, T.DecimalType):
        unscaled = (c * F.lit(10**kind.scale)).cast("decimal(38,0)")
        return ((unscaled - F.pmod(unscaled, F.lit(width))) / F.lit(10**kind.scale)).cast(kind)
    return c - F.pmod(c, F.lit(width).cast(kind))


def _day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def year(c: Column) -> Column:
    return F.year(c) - 1970


def month(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    return _day(c)


def hour(c: Column) -> Column:
    return _day(c) * 24 + F.hour(c)


def _shifted(x: Column, by: int) -> Column:
    """32-bit rotation to the left, on longs."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 32 - by)).bitwiseAND(F.lit(_MASK))


def _times(x: Column, by: int) -> Column:
    """The low 32 bits of a product, by halves so that longs don't overflow."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
    return (low * by + F.shiftleft((high * by).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _murmur(blocks: list[Column], length: int) -> Column:
    """Murmur3 of 32 bits with seed 0 over whole little-endian 32-bit blocks."""

    def step(h: Column, k: Column) -> Column:
        k = _times(_shifted(_times(k, 0xCC9E2D51), 15), 0x1B873593)
        return (_shifted(h.bitwiseXOR(k), 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(_MASK))

    return _finish(reduce(step, blocks, F.lit(0).cast("long")), length)


def _finish(h: Column, length: int) -> Column:
    h = h.bitwiseXOR(F.lit(length).cast("long"))
    h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def bucket_hash(c: Column, kind: T.DataType) -> Column:
    """The public bucket hash of integers, dates and timestamps: Murmur3 of the value as an eight-byte integer."""
    if isinstance(kind, T.DateType):
        value = _day(c).cast("long")
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        value = _day(c).cast("long") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.date_format(c, "ss").cast("long") * 1_000_000 + F.date_format(c, "SSSSSS").cast("long"))
    elif isinstance(kind, T.IntegralType):
        value = c.cast("long")
    else:
        raise TypeError(f"no bucket of {kind.simpleString()}")
    return _murmur([value.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(value, 32)], 8)


def bucket(c: Column, n: int, kind: T.DataType) -> Column:
    return F.pmod(bucket_hash(c, kind).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")
