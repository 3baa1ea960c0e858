"""Hashes whose exact values are part of the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seeds count up from BASE, as 4 bytes and 28 zero bytes; the constants of FNV-1 (32 bits).
BASE = 1_700_000_000
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def seed(i: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.lower(F.hex(F.lit(BASE) + i)), 8, "0"), F.lit("00" * 28)))


def seeded(data: Column, i: Column) -> Column:
    """The MD5 of data and the i-th seed, as 32 hex digits."""
    return F.md5(F.concat(data.cast("binary"), seed(i)))


def low_bits(digest: Column) -> Column:
    """The lower 32 of a digest's first 64 bits."""
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def high_word(digest: Column) -> Column:
    """A digest's first 64 bits as an unsigned number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def fnv1(data: Column) -> Column:
    """FNV-1, 32 bits, over the bytes of a string."""
    digits = F.hex(data.cast("binary"))
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    values = F.when(F.octet_length(data) > 0, F.transform(places, lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    step = lambda a, b: (a * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(FNV_MASK)).bitwiseXOR(b)
    return F.aggregate(values, F.lit(FNV_OFFSET).cast("long"), step)
