"""Exact, mergeable sketches as plain aggregates: Bloom filter, Count-Min, HyperLogLog, SimHash.

A sketch is a table of its positive cells, so merging is a union and one more aggregate, and
adding is combined before the exchange. Null values are not added.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.hashing import halves, modulo, seed


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n elements at a false positive rate p."""
    n = max(1, n)
    p = p if 0 < p < 1 else 0.01
    m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / n * math.log(2)))


def bloom_positions(value: Column, m: int, k: int) -> Column:
    return F.array_distinct(F.array(*[modulo(value, seed(i), m) for i in range(k)]))


def bloom_bits(df: DataFrame, by: list[str], value: str, m: int, k: int) -> DataFrame:
    """by, bit: the set bits."""
    return df.where(F.col(value).isNotNull()).select(*by, F.explode(bloom_positions(F.col(value), m, k)).alias("bit")).distinct()


def bloom_contains(df: DataFrame, by: list[str], value: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Distinct by, value, and whether all of its bits are set."""
    asked = df.select(*by, value).where(F.col(value).isNotNull()).distinct()
    each = asked.select(*by, value, F.explode(bloom_positions(F.col(value), m, k)).alias("bit"))
    hit = each.join(bits.withColumn("set", F.lit(1)), [*by, "bit"], "left")
    return hit.groupBy(*by, value).agg((F.count("*") == F.count("set")).alias("contained"))


def cms_size(accuracy: float, confidence: float) -> tuple[int, int]:
    """Columns and rows of a Count-Min table."""
    accuracy = accuracy if 0 < accuracy < 1 else 0.01
    confidence = confidence if 0 < confidence < 1 else 0.99
    return math.ceil(math.e / accuracy), math.ceil(math.log(1 / (1 - confidence)))


def _cms_cells(value: Column, m: int, k: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("row"), modulo(value, seed(i), m).alias("col")) for i in range(k)]))


def cms_table(df: DataFrame, by: list[str], value: str, m: int, k: int) -> DataFrame:
    """by, row, col, n. Values are counted before they are hashed."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.select(*by, _cms_cells(F.col(value), m, k).alias("c"), "n").groupBy(*by, "c.row", "c.col").agg(F.sum("n").alias("n"))


def cms_estimate(df: DataFrame, by: list[str], value: str, cells: DataFrame, m: int, k: int) -> DataFrame:
    """Distinct by, value, and the least of its cells."""
    asked = df.select(*by, value).where(F.col(value).isNotNull()).distinct().select(*by, value, _cms_cells(F.col(value), m, k).alias("c"))
    hit = asked.select(*by, value, "c.row", "c.col").join(cells, [*by, "row", "col"], "left")
    return hit.groupBy(*by, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_registers(df: DataFrame, by: list[str], value: str, p: int = 14) -> DataFrame:
    """by, idx, rank: registers above 0."""
    high, low = halves(F.col(value), seed(0))
    rest = F.shiftleft(high.bitwiseAND(F.lit((1 << (32 - p)) - 1)), 32).bitwiseOR(low)
    rank = F.when(rest == 0, 64 - p + 1).otherwise(64 - p - F.length(F.bin(rest)) + 1)
    placed = df.where(F.col(value).isNotNull()).select(*by, F.shiftright(high, 32 - p).alias("idx"), rank.alias("rank"))
    return placed.groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def hll_count(registers: DataFrame, by: list[str], p: int = 14) -> DataFrame:
    """by, estimate."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    filled = registers.groupBy(*by).agg((m - F.count("*")).alias("zeros"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    raw = F.lit(alpha * m * m) / (F.col("s") + F.col("zeros"))
    small = F.when((raw <= 2.5 * m) & (F.col("zeros") > 0), m * F.ln(m / F.col("zeros"))).otherwise(raw)
    large = F.when(small > 2.0**64 / 30, -(2.0**64) * F.ln(1 - small / 2.0**64)).otherwise(small)
    return filled.select(*by, F.floor(large + 0.5).alias("estimate"))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, hi, lo: the halves of the 64-bit fingerprint; 0 without tokens.

    Every occurrence counts, so no frequencies are needed; the 64 sums of a text meet before the exchange.
    """
    high, low = halves(F.col("t"), seed(0))
    # A column of its own for the digest, so that it is computed once for all bits.
    each = df.where(F.col(key).isNotNull()).select(key, F.explode_outer(tokens(F.col(text))).alias("t")).select(key, "t", high.alias("h"), low.alias("l"))
    bit = lambda half, b: F.sum(F.shiftrightunsigned(half, b).bitwiseAND(F.lit(1)) * 2 - 1)
    sums = each.groupBy(key).agg(F.count("t").alias("n"), *[bit(F.col(x), b).alias(f"{x}{b}") for x in "hl" for b in range(32)])
    half = lambda x: F.when(F.col("n") == 0, 0).otherwise(sum((F.when(F.col(f"{x}{b}") >= 0, F.lit(1 << b)).otherwise(0) for b in range(32)), F.lit(0).cast("long")))
    return sums.select(key, half("h").cast("long").alias("hi"), half("l").cast("long").alias("lo"))


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def parse_fingerprint(text: str) -> int:
    """A fingerprint from its sixteen hexadecimal digits."""
    if len(text) != 16 or set(text.lower()) - set("0123456789abcdef"):
        raise ValueError(f"{text!r} is no fingerprint of sixteen hexadecimal digits")
    return int(text, 16)


def near_fingerprints(prints: DataFrame, most: int = 3, spare: int = 3) -> DataFrame:
    """Pairs of different fingerprints (hi, lo) within `most` bits: a_hi, a_lo, b_hi, b_lo, distance.

    Exact: the 64 bits are cut into most + spare blocks, and two prints within the distance
    agree in some choice of `spare` whole blocks (half of the bits for three of six), so buckets are small.
    A pair comes from the first choice in which it agrees, so it needs no removal of repeats.
    Equal texts are one fingerprint, so copies are never paired.
    """
    blocks = most + spare
    each = prints.select("hi", "lo").where("hi is not null and lo is not null").distinct()
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    signed = lambda x: x - (x >> 63 << 64)
    masks = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    # A choice is the set of its blocks as bits; the highest bit of a print is flipped, so that longs have the order of (hi, lo).
    keys = [F.struct(F.lit(sum(1 << i for i in c)).alias("choice"), F.col("x").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("part")) for c in combinations(range(blocks), spare)]
    whole = each.select(F.shiftleft(F.col("hi") - (1 << 31), 32).bitwiseOR(F.col("lo")).alias("x"))
    banded = whole.select("x", F.explode(F.array(*keys)).alias("k")).select("x", "k.choice", "k.part")
    # Each print has a row per choice here, which no estimate of sizes knows of: without the hint the table is broadcast.
    pairs = banded.withColumnRenamed("x", "a").join(banded.withColumnRenamed("x", "b").hint("merge"), ["choice", "part"]).where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = pairs.withColumn("distance", F.bit_count(diff)).where(F.col("distance") <= most)
    others = sum((F.when(diff.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)), F.lit(0)).bitwiseXOR(F.col("choice"))
    first = near.withColumn("others", others).where("others = 0 or (others & -others) > choice")
    half = lambda x, n: [(F.shiftright(x, 32) + (1 << 31)).alias(f"{n}_hi"), F.col(x).bitwiseAND(F.lit((1 << 32) - 1)).alias(f"{n}_lo")]
    return first.select(*half("a", "a"), *half("b", "b"), "distance")
