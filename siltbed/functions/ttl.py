"""Time-to-live literals: an integer and a case-sensitive unit (none means seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of each unit, longest suffix first.
UNITS = {"ms": 1, "min": 60_000, "s": 1000, "h": 3_600_000, "D": 86_400_000, "M": 2_592_000_000, "Y": 31_536_000_000, "": 1000}


def parse_ttl(text: Column) -> Column:
    """Milliseconds of a literal such as 90, 15s, 10min, 2h, 7D, 3M or 1Y; null if it is none, or more than 64 bits hold."""
    number = F.regexp_extract(text, "^([0-9]+)(ms|min|s|h|D|M|Y|)$", 1)
    unit = F.regexp_extract(text, "^([0-9]+)(ms|min|s|h|D|M|Y|)$", 2)
    factor = F.lit(None).cast("long")
    for name, ms in UNITS.items():
        factor = F.when(unit == name, F.lit(ms).cast("long")).otherwise(factor)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), factor))
