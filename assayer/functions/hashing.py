"""Numbers in [0, 1) out of text, the same in any engine, on any partitioning and in any row order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_bits(key: str | Column, value: Column) -> Column:
    """The first 64 bits of sha256(key, NUL, value as text), as 16 hex digits."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat(key, F.lit("\0"), value.cast("string")), 256), 1, 16)


def unit_hash(key: str | Column, value: Column) -> Column:
    """The first 64 bits, big-endian, of sha256(key, NUL, value as text), over 2**64. Null for a null value."""
    # to base -10 the bits are a signed long; its halves are exact as doubles, so their sum is rounded once
    bits = F.conv(_first_bits(key, value), 16, -10).cast("long")
    return (F.shiftrightunsigned(bits, 32) * float(1 << 32) + bits.bitwiseAND(F.lit((1 << 32) - 1))) / float(1 << 64)


def below(key: str, value: Column, share: float) -> Column:
    """Whether ``unit_hash`` is below ``share``, told by its digits: no number is made of them. Null for a null value."""
    low, high = 0, 1 << 64  # the least bits that are not below
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if mid / float(1 << 64) < share else (low, mid)
    return _first_bits(key, value) < F.lit(f"{low:016x}" if low < 1 << 64 else "g")


def unit_hash_of(key: str, value: object) -> float:
    """The same of one value, on the driver."""
    return int.from_bytes(hashlib.sha256(f"{key}\0{value}".encode()).digest()[:8], "big") / float(1 << 64)


def pick(seed: Column, slots: Column) -> Column:
    """A whole number in [0, slots) out of the first 32 bits of sha256(seed)."""
    bits = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long")
    return F.floor(bits / float(1 << 32) * slots).cast("long")
