"""The sketches' hash: the first eight bytes, big-endian, of MD5(value || seed).

It is carried as two longs of 32 bits, so that no unsigned 64-bit number is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halves(value: Column, seed: bytes) -> tuple[Column, Column]:
    """High and low 32 bits of the hash of a binary or string column."""
    digest = F.md5(F.concat(value.cast("binary"), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def modulo(value: Column, seed: bytes, m: int) -> Column:
    """The hash modulo m, for m below 2**31."""
    high, low = halves(value, seed)
    return ((high % m) * ((1 << 32) % m) + low) % m


def seed(i: int) -> bytes:
    return f"siltbed-{i}".encode()
