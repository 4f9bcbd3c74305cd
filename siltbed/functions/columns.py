"""Column expressions for keys, times, names and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Op codes and record types of the log.
PUT, DEL, MERGE, RANGEDEL = 0, 1, 2, 3
SINGLE, START, TXN, COMMIT = 0, 1, 2, 3
#: Keys that begin with this byte belong to sketches and are hidden from users.
RESERVED = 0x01


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read in the session's zone."""
    return F.unix_micros(at.cast("timestamp"))


def epoch_seconds(seconds: Column) -> Column:
    """Unix seconds as a timestamp without zone in UTC, whatever the session's zone is."""
    local = F.timestamp_seconds(seconds).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def last_component(path: Column) -> Column:
    """The part of a path behind its last slash; the whole of a path without one."""
    return F.substring_index(path, "/", -1)


def is_word(value: Column, word: str) -> Column:
    """Equal to word apart from case and surrounding blanks; null counts as unequal."""
    return F.coalesce(F.lower(F.trim(value)) == word, F.lit(False))


def not_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def is_reserved(key: Column) -> Column:
    """True of keys whose first byte is 0x01."""
    return F.coalesce(F.substring(key, 1, 1) == F.lit(bytes([RESERVED])), F.lit(False))


def name_stems(name: Column) -> Column:
    """The name, and every shorter one that is followed by a dot and more in it.

    a.b.c gives a.b.c, a.b and a. Names have few dots, so the array is short.
    """
    parts = F.split(name, r"\.")
    upto = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, 1, n), "."),
    )
    return F.array_distinct(F.filter(upto, lambda s: (F.length(name) > F.length(s) + 1) | (s == name)))
