"""Folding sketch records: a base and its operands become one state, by the kind of the sketch.

A reserved key is 0x01, a kind and a name. A value is a marker and a payload: 0x00 and a state (a
base, which restarts the sketch) or 0xFF and an item (an operand, which is added). A fold says which
cells an item touches and how equal cells combine, so a state is a bounded table of cells,
operands are combined before any exchange, and a sketch with very many operands is
no unbounded group. Further kinds are added with register().

A state is encoded as a letter, the kind, two parameters and its cells in full (codec below). A base that is no encoded
state begins an empty sketch with the default parameters of its kind.

Nulls and oddities: records without store, key or sequence id, and empty values, are none; repeated ones are one.
A delete ends all before it. A sketch whose oldest record is an operand is an error, as is an
unknown kind: it comes out with an error and without a state. Kinds without cells keep their newest record.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL, MERGE, is_reserved
from siltbed.functions.hashing import seed
from siltbed.operators.sketches import bloom_size, cms_size
from siltbed.session import ship

# Kinds by the second byte of a key, and the markers of a value.
BLOOM, CMS, HLL, SIMHASH = 1, 2, 3, 4
BASE, OPERAND = b"\x00", b"\xff"

KEY = ["store_id", "key"]
_HEADER = struct.Struct("<cBII")


@dataclass(frozen=True)
class Fold:
    """How items of one kind of sketch become cells.

    cells: item and the two parameters to array<struct<pos long, n long>>; size: number of cells
    of the parameters; summed: cells add up (else the larger one stays); bits: bits of a cell in the codec (1, 8 or 64).
    """

    name: str
    cells: Callable[[Column, Column, Column], Column]
    size: Callable[[int, int], int]
    summed: bool
    bits: int
    default: tuple[int, int]


def _hash(item: Column, i: Column) -> tuple[Column, Column]:
    digest = F.md5(F.concat(item, F.concat(F.lit("siltbed-"), i.cast("string")).cast("binary")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def _modulo(item: Column, i: Column, m: Column) -> Column:
    high, low = _hash(item, i)
    return ((high % m) * (F.lit(1 << 32) % m) + low) % m


def _cell(pos: Column, n: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), n.cast("long").alias("n"))


def _bloom_cells(item: Column, m: Column, k: Column) -> Column:
    return F.transform(F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: _modulo(item, i, m))), lambda p: _cell(p, F.lit(1)))


def _cms_cells(item: Column, m: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: _cell(i * m + _modulo(item, i, m), F.lit(1)))


def _hll_cells(item: Column, p: Column, _: Column) -> Column:
    high, low = _hash(item, F.lit(0))
    rest = F.call_function("shiftleft", high.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - p.cast("int")) - 1), F.lit(32)).bitwiseOR(low)
    rank = F.when(rest == 0, 64 - p + 1).otherwise(64 - p - F.length(F.bin(rest)) + 1)
    return F.array(_cell(F.call_function("shiftright", high, F.lit(32) - p.cast("int")), rank))


REGISTRY: dict[int, Fold] = {}


def register(kind: int, fold: Fold) -> None:
    if kind in REGISTRY or kind == SIMHASH or not 0 < kind < 256 or fold.bits not in (1, 8, 64):
        raise ValueError(f"kind {kind} can't be registered")
    REGISTRY[kind] = fold


register(BLOOM, Fold("bloom", _bloom_cells, lambda m, k: m, False, 1, bloom_size(1000, 0.01)))
register(CMS, Fold("cms", _cms_cells, lambda m, k: m * k, True, 64, cms_size(0.01, 0.99)))
register(HLL, Fold("hll", _hll_cells, lambda p, _: 1 << p, False, 8, (14, 0)))


# The codec.


def encode(kind: int, a: int, b: int, pos, n) -> bytes:
    """A state with these cells; all others are 0."""
    fold = REGISTRY[kind]
    cells = np.zeros(fold.size(a, b), {1: np.uint8, 8: np.uint8, 64: "<u8"}[fold.bits])
    cells[np.asarray(pos, np.int64)] = np.asarray(n, np.int64)
    return _HEADER.pack(b"S", kind, a, b) + (np.packbits(cells) if fold.bits == 1 else cells).tobytes()


def decode(state: bytes) -> tuple[int, int, int, np.ndarray] | None:
    """Kind, parameters and all cells of an encoded state; None if it is none."""
    if state is None or len(state) < _HEADER.size:
        return None
    letter, kind, a, b = _HEADER.unpack_from(state)
    if letter != b"S" or kind not in REGISTRY:
        return None
    fold, body = REGISTRY[kind], state[_HEADER.size :]
    size = fold.size(a, b)
    if len(body) != -(-size * fold.bits // 8):
        return None
    cells = np.unpackbits(np.frombuffer(body, np.uint8))[:size] if fold.bits == 1 else np.frombuffer(body, {8: np.uint8, 64: "<u8"}[fold.bits])
    return kind, a, b, cells


def empty(kind: int, a: int, b: int) -> bytes:
    return encode(kind, a, b, [], [])


def clear(state: bytes) -> bytes:
    """The same sketch without items."""
    found = decode(state)
    if found is None:
        raise ValueError("this is no state of a sketch")
    return empty(*found[:3])


def merge(one: bytes, other: bytes) -> bytes:
    """Both sketches together; refused unless kind and parameters (and so the hashes' seeds) are equal."""
    x, y = decode(one), decode(other)
    if x is None or y is None:
        raise ValueError("this is no state of a sketch")
    if x[:3] != y[:3]:
        raise ValueError(f"sketches of kinds and parameters {x[:3]} and {y[:3]} can't be merged")
    cells = x[3] + y[3] if REGISTRY[x[0]].summed else np.maximum(x[3], y[3])
    at = np.flatnonzero(cells)
    return encode(*x[:3], at, cells[at])


def _number(item: bytes, i: int) -> int:
    return int.from_bytes(hashlib.md5(item + seed(i)).digest()[:8], "big")


def contains(state: bytes, item: bytes) -> bool:
    """Whether a Bloom filter may have the item."""
    _, m, k, bits = decode(state)
    return all(bits[_number(item, i) % m] for i in range(k))


def frequency(state: bytes, item: bytes) -> int:
    """A Count-Min sketch's estimate, never too low."""
    _, m, k, cells = decode(state)
    return int(min(cells[i * m + _number(item, i) % m] for i in range(k)))


def distinct(state: bytes) -> int:
    """A HyperLogLog sketch's estimate."""
    _, p, _, ranks = decode(state)
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    raw, zeros = alpha * m * m / float(np.sum(2.0 ** -ranks.astype(float))), int(np.sum(ranks == 0))
    if raw <= 2.5 * m and zeros:
        raw = m * math.log(m / zeros)
    elif raw > 2.0**64 / 30:
        raw = -(2.0**64) * math.log(1 - raw / 2.0**64)
    return math.floor(raw + 0.5)


# Folding tables of records.


def sketch_records(records: DataFrame) -> DataFrame:
    """Distinct deletes and merges of reserved keys: store_id, key, seq_id, op_type, value."""
    rows = records.where(is_reserved(F.col("key")) & (F.length("key") >= 2) & F.col("op_type").isin(DEL, MERGE) & F.col("store_id").isNotNull() & F.col("seq_id").isNotNull())
    return rows.where((F.col("op_type") == DEL) | (F.length("value") > 0)).select(*KEY, "seq_id", "op_type", "value").dropDuplicates([*KEY, "seq_id"])


def _live(records: DataFrame) -> DataFrame:
    """Records behind the last delete of their key."""
    rows = sketch_records(records)
    ended = rows.where(F.col("op_type") == DEL).groupBy(*KEY).agg(F.max("seq_id").alias("ended"))
    return rows.where(F.col("op_type") == MERGE).join(ended, KEY, "left").where("ended is null or seq_id > ended").drop("ended", "op_type")


def kind_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 2, 1)), 16, 10).cast("int")


def fold(records: DataFrame) -> DataFrame:
    """Each sketch that isn't deleted: store_id, key, kind, base_seq, operands, newest_seq, a, b, cells, newest, error.

    a and b are its parameters, cells (array of pos, n; by pos) its state, newest the payload of its newest record. operands counts those behind the base.
    """
    ship(records.sparkSession)
    live = _live(records).withColumn("is_base", F.substring("value", 1, 1) == F.lit(BASE)).withColumn("payload", F.expr("substring(value, 2)"))
    base, operand = F.when(F.col("is_base"), F.col("seq_id")), F.when(~F.col("is_base"), F.col("seq_id"))
    # One row a sketch; payloads of bases are bounded by the sketch's size.
    heads = live.groupBy(*KEY).agg(
        F.min(base).alias("first_base"), F.max(base).alias("base_seq"), F.min(operand).alias("first_operand"), F.max("seq_id").alias("newest_seq"),
        F.max_by("payload", base).alias("base_state"), F.max_by("payload", "seq_id").alias("newest"),
    ).withColumn("kind", kind_of(F.col("key")))
    early = F.col("first_operand").isNotNull() & (F.col("first_base").isNull() | (F.col("first_operand") < F.col("first_base")))
    known = sorted(REGISTRY)
    error = F.when(~F.col("kind").isin(*known, SIMHASH), "no fold for this kind").when((F.col("kind") != SIMHASH) & early, "operand before base")

    @F.pandas_udf("a long, b long, pos array<long>, n array<long>")
    def opened(kind: pd.Series, state: pd.Series) -> pd.DataFrame:
        rows = []
        for k, s in zip(kind, state):
            found = decode(bytes(s)) if s is not None else None
            if found is None or found[0] != k:
                rows.append((*(REGISTRY[k].default if k in REGISTRY else (0, 0)), [], []))
            else:
                at = np.flatnonzero(found[3])
                rows.append((found[1], found[2], at.tolist(), found[3][at].tolist()))
        return pd.DataFrame(rows, columns=["a", "b", "pos", "n"])

    heads = heads.withColumn("error", error).withColumn("o", opened("kind", "base_state")).drop("base_state")
    good = heads.where(F.col("error").isNull() & (F.col("kind") != SIMHASH))
    held = good.select(*KEY, "kind", F.explode(F.arrays_zip(F.col("o.pos").alias("pos"), F.col("o.n").alias("n"))).alias("c")).select(*KEY, "kind", "c.pos", "c.n")
    params = good.select(*KEY, "kind", "base_seq", F.col("o.a").alias("a"), F.col("o.b").alias("b"))
    # Equal operands are counted before they are hashed.
    added = live.where("not is_base").join(params, KEY).where("seq_id > base_seq").groupBy(*KEY, "kind", "a", "b", "payload").agg(F.count("*").alias("times"))
    touched = F.lit(None).cast("array<struct<pos: bigint, n: bigint>>")
    for k, f in REGISTRY.items():
        touched = F.when(F.col("kind") == k, f.cells(F.col("payload"), F.col("a"), F.col("b"))).otherwise(touched)
    summed = F.col("kind").isin([k for k, f in REGISTRY.items() if f.summed])
    each = added.select(*KEY, "kind", "times", F.explode(touched).alias("c")).select(*KEY, "kind", "c.pos", F.when(summed, F.col("c.n") * F.col("times")).otherwise(F.col("c.n")).alias("n"))
    cells = held.unionByName(each).groupBy(*KEY, "kind", "pos").agg(F.when(summed, F.sum("n")).otherwise(F.max("n")).alias("n"))
    # A list is as long as its sketch has cells, at most.
    cells = cells.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("cells"))
    behind = live.where("not is_base").join(params.select(*KEY, "base_seq"), KEY).where("seq_id > base_seq").groupBy(*KEY).agg(F.count("*").alias("operands"))
    out = heads.join(cells, KEY, "left").join(behind, KEY, "left").na.fill(0, ["operands"])
    return out.select(*KEY, "kind", "base_seq", "operands", "newest_seq", F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.coalesce("cells", F.array().cast("array<struct<pos: bigint, n: bigint>>")).alias("cells"), "newest", "error")


def encoded(kind: Column, a: Column, b: Column, cells: Column) -> Column:
    """The binary state of a fold's row."""

    @F.pandas_udf("binary")
    def pack(kind: pd.Series, a: pd.Series, b: pd.Series, pos: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([encode(*row) for row in zip(kind, a, b, pos, n)], dtype=object)

    return pack(kind, a, b, F.transform(cells, lambda c: c["pos"]), F.transform(cells, lambda c: c["n"]))


def compacted(records: DataFrame, keep_deletes: bool) -> DataFrame:
    """The records a compaction writes for the sketches in its input: store_id, key, seq_id, op_type, value.

    One base a sketch, under its newest sequence id. Sketches with an error keep their records, as an operand's base may lie
    in files that take no part. keep_deletes: a newest delete stays.
    """
    folded = fold(records)
    done = folded.where("error is null")
    cellular = done.where(F.col("kind") != SIMHASH).select(*KEY, F.col("newest_seq").alias("seq_id"), F.concat(F.lit(BASE), encoded(F.col("kind"), F.col("a"), F.col("b"), F.col("cells"))).alias("value"))
    newest = done.where(F.col("kind") == SIMHASH).select(*KEY, F.col("newest_seq").alias("seq_id"), F.concat(F.lit(BASE), "newest").alias("value"))
    raw = _live(records).join(folded.where("error is not null").select(*KEY), KEY, "left_semi").select(*KEY, "seq_id", "value")
    out = cellular.unionByName(newest).unionByName(raw).select(*KEY, "seq_id", F.lit(MERGE).cast("byte").alias("op_type"), "value")
    if keep_deletes:
        last = sketch_records(records).groupBy(*KEY).agg(F.max("seq_id").alias("seq_id"), F.max_by("op_type", "seq_id").alias("op"))
        ended = last.where(F.col("op") == DEL).select(*KEY, "seq_id", F.lit(DEL).cast("byte").alias("op_type"), F.lit(None).cast("binary").alias("value"))
        # Operands behind a delete have no base here, so the delete matters to them only by what is older: it stays too.
        before = sketch_records(records).where(F.col("op_type") == DEL).groupBy(*KEY).agg(F.max("seq_id").alias("seq_id")).join(folded.where("error is not null").select(*KEY), KEY, "left_semi")
        out = out.unionByName(ended).unionByName(before.select(*KEY, "seq_id", F.lit(DEL).cast("byte").alias("op_type"), F.lit(None).cast("binary").alias("value")))
    return out


def digests(folded: DataFrame) -> DataFrame:
    """A fold's rows with the number of cells and an MD5 of the state in place of it."""
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["pos"], c["n"])), ",")
    lone = F.col("kind") == SIMHASH
    cells = F.when(lone, 1).otherwise(F.size("cells")).cast("long")
    digest = F.md5(F.when(lone, F.hex("newest")).otherwise(text).cast("binary"))
    bad = F.col("error").isNotNull()
    return folded.select(*KEY, "kind", "base_seq", "operands", "newest_seq", F.when(bad, F.lit(0).cast("long")).otherwise(cells).alias("cells"), F.when(~bad, digest).alias("digest"), F.coalesce("error", F.lit("")).alias("error"))
