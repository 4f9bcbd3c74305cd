"""The visible state of a store at any moment, as a pure function of its log.

Order of decisions: newest version of each key, then its operation, then range deletes of
higher sequence id (both ends inclusive), then expiry (expired when expires_at_ms <= now). A
newest version that is deleted, covered or expired hides all older ones.

Nulls: records without store, key or sequence id are ignored; an expiry of null or 0 is none.
Records delivered again are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL, MERGE, PUT, RANGEDEL, is_reserved
from siltbed.operators.cover import covering
from siltbed.session import scratch, settle

#: Range deletes up to this number are sent to every task and compared one by one; more are swept in key order.
FEW_RANGES = 64


def versions(effective: DataFrame, as_of: int | None = None) -> DataFrame:
    """Every distinct put, delete and merge (store_id, key, seq_id, op_type, value, expires_at_ms)."""
    rows = effective.where(F.col("op_type").isin(PUT, DEL, MERGE)).where("store_id is not null and key is not null and seq_id is not null")
    if as_of is not None:
        rows = rows.where(F.col("seq_id") <= as_of)
    columns = ["store_id", "key", "seq_id", "op_type", "value", "expires_at_ms"]
    # Copies agree in everything, so one of them is taken by the numbers alone, and no value is sorted.
    return rows.select(*columns).dropDuplicates(["store_id", "key", "seq_id", "op_type"])


def tombstones(effective: DataFrame, as_of: int | None = None) -> DataFrame:
    """Distinct range deletes: store_id, start_key, end_key, seq_id."""
    rows = effective.where(F.col("op_type") == RANGEDEL).where("store_id is not null and seq_id is not null and key <= value")
    if as_of is not None:
        rows = rows.where(F.col("seq_id") <= as_of)
    return rows.select("store_id", F.col("key").alias("start_key"), F.col("value").alias("end_key"), "seq_id").distinct()


def newest(effective: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest version of each key, whatever its operation; partial sums meet before the exchange, so hot keys don't matter."""
    rest = F.struct("op_type", "value", "expires_at_ms")
    rows = effective.where(F.col("op_type").isin(PUT, DEL, MERGE)).where("store_id is not null and key is not null and seq_id is not null")
    if as_of is not None:
        rows = rows.where(F.col("seq_id") <= as_of)
    top = rows.groupBy("store_id", "key").agg(F.max("seq_id").alias("seq_id"), F.max_by(rest, "seq_id").alias("r"))
    return top.select("store_id", "key", "seq_id", "r.*")


def with_cover(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (store_id, key, seq_id, ...; one a store and key) with cover_seq, the highest newer range delete over the key, or null.

    The last join is by store and key, as the rows of newest() lie already, so their values aren't moved again.
    """
    spark = rows.sparkSession
    ranges = settle(ranges, scratch(spark, "ranges"))
    if ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        r = ranges.select(F.col("store_id").alias("r_store"), "start_key", "end_key", F.col("seq_id").alias("r_seq"))
        over = (F.col("store_id") == F.col("r_store")) & F.col("key").between(F.col("start_key"), F.col("end_key")) & (F.col("r_seq") > F.col("seq_id"))
        hit = rows.select("store_id", "key", "seq_id").join(F.broadcast(r), over).groupBy("store_id", "key").agg(F.max("r_seq").alias("cover_seq"))
    else:
        points = settle(rows.select(F.col("store_id").cast("long").alias("space"), "key", "seq_id"), scratch(spark, "points"))
        swept = covering(points, ranges.select(F.col("store_id").cast("long").alias("space"), F.col("start_key").alias("lo"), F.col("end_key").alias("hi"), "seq_id"))
        hit = swept.where("cover_seq > seq_id").select(F.col("space").cast(rows.schema["store_id"].dataType).alias("store_id"), "key", "cover_seq")
    return rows.join(hit, ["store_id", "key"], "left")


def not_expired(now_ms: int) -> Column:
    expires = F.nullif(F.col("expires_at_ms"), F.lit(0))
    return expires.isNull() | (expires > now_ms)


def state(effective: DataFrame, now_ms: int | None = None, as_of: int | None = None) -> DataFrame:
    """Visible user rows: store_id, key, seq_id, value, expires_at_ms. Without now_ms nothing expires."""
    rows = newest(effective, as_of).where((F.col("op_type") == PUT) & ~is_reserved(F.col("key")))
    rows = with_cover(rows, tombstones(effective, as_of)).where("cover_seq is null").drop("cover_seq", "op_type")
    return rows if now_ms is None else rows.where(not_expired(now_ms))


def fragments(ranges: DataFrame) -> DataFrame:
    """Disjoint pieces of range deletes (store_id, start_key, end_key, seq_id): store_id, start_key, past_key (exclusive), seq_id of the newest over the piece.

    An inclusive end e is the exclusive end e + 0x00, the next possible key.
    """
    past = F.concat("end_key", F.lit(b"\x00"))
    edges = ranges.select("store_id", F.col("start_key").alias("key")).unionByName(ranges.select("store_id", past.alias("key"))).distinct()
    from siltbed.operators.ordered import numbered

    edges = settle(numbered(edges, ["store_id"], [F.col("key").asc()], "n"), scratch(ranges.sparkSession, "edges"))
    after = edges.select("store_id", (F.col("n") - 1).alias("n"), F.col("key").alias("past_key"))
    pieces = edges.join(after, ["store_id", "n"])
    points = settle(pieces.select("store_id", "key", "past_key", F.lit(-1).cast("long").alias("seq_id")), scratch(ranges.sparkSession, "pieces"))
    return with_cover(points, ranges).where("cover_seq is not null").select("store_id", F.col("key").alias("start_key"), "past_key", F.col("cover_seq").alias("seq_id"))
