"""64-bit keys of strings, buckets of keys, and the probes of bloom filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 64
#: Replaces a half of a key that is zero, which would make all probes of a filter the same. Our choice.
NONZERO = 1540483477


def key64(text: Column) -> Column:
    """The first 60 bits of the string's md5 as a BIGINT, never negative; null for null. Other SQL engines can compute it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def bucket(key: Column) -> Column:
    """One of 64 physical partitions, from the key's low six bits."""
    return F.pmod(key.bitwiseAND(BUCKETS - 1) + 32, F.lit(BUCKETS)).cast("int")


def remix(key: Column) -> Column:
    """Spreads a value over all 64 bits; for internal use, as no other engine has this hash."""
    return F.xxhash64(key)


def to_bytes(x: Column) -> Column:
    """A BIGINT as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def from_bytes(data: Column) -> Column:
    """The BIGINT of eight bytes, the highest first."""
    unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    return F.when(unsigned >= F.lit(str(2**63)).cast("decimal(20,0)"), unsigned - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(unsigned).cast("long")


def int32(x: Column) -> Column:
    """A BIGINT wrapped to the range of 32 signed bits."""
    return F.shiftright(F.call_function("shiftleft", x, F.lit(32)), 32)


def probes(key: Column, hashes: int, bits: int) -> Column:
    """The array of a key's ``hashes`` places in a filter of ``bits`` bits: low half + i * high half in 32 bits, i from 1,
    complemented where negative. Spark compiles these expressions, where it would interpret a lambda; they are short, as
    a method of over 8000 bytes is interpreted again."""

    def half(x: Column) -> Column:
        return F.when(int32(x) == 0, F.lit(NONZERO)).otherwise(int32(x)).cast("long")

    low, high = half(key), half(F.shiftrightunsigned(key, 32))

    def place(i: int) -> Column:
        x = int32(low + F.lit(i).cast("long") * high)
        return x.bitwiseXOR(F.shiftright(x, 63)) % F.lit(bits).cast("long")

    return F.array(*[place(i) for i in range(1, hashes + 1)])
