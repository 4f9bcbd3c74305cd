"""Which subscriptions does a change concern? Point events in ranges, and ranges that overlap.

Bounds are inclusive; an empty one is open. A few subscriptions are sent to every task. More are
cut into key buckets at sampled keys of events and subscriptions: two ranges overlap if the beginning of one lies in the other, so
points meet ranges in the buckets of a range's ends, or in the aligned blocks of buckets between these, of which a range has few.
Events without a key, and ranges and subscriptions that end before they begin, concern nobody.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.operators.cover import _blocks, sample_cuts
from siltbed.session import ship

#: Subscriptions that are sent to every task, at most.
FEW = 64


def _bounds(key_lo: Column, key_hi: Column) -> Column:
    return ((F.length("lower") == 0) | (F.col("lower") <= key_hi)) & ((F.length("upper") == 0) | (F.col("upper") >= key_lo))


def _meet(events: DataFrame, subscriptions: DataFrame, last: str) -> DataFrame:
    """events (key to last) with the subscriptions (listener_id, lower, upper) they overlap."""
    subscriptions = subscriptions.select("listener_id", "lower", "upper").where("lower is not null and (length(upper) = 0 or lower <= upper)")
    concerns = _bounds(F.col("key"), F.col(last))
    if events.isStreaming or subscriptions.limit(FEW + 1).count() <= FEW:
        return events.join(F.broadcast(subscriptions), concerns)
    ship(events.sparkSession)
    space = F.lit(0).cast("long").alias("space")
    cuts = sample_cuts(subscriptions.select(space, F.col("lower").alias("key")).unionByName(events.select(space, "key")))

    @F.pandas_udf(T.LongType())
    def bucket(key):
        import pandas as pd

        return pd.Series([bisect_right(cuts, (0, k)) for k in key], dtype="int64")

    @F.pandas_udf("array<struct<level: int, block: bigint>>")
    def places(first, last):
        import pandas as pd

        return pd.Series([[{"level": -1, "block": int(b)} for b in sorted({f, t})] + [{"level": k, "block": i} for k, i in _blocks(f + 1, t)] for f, t in zip(first, last)])

    def within(points: DataFrame, ranges: DataFrame, lo: Column, hi: Column, point: Column, open_end: Column) -> DataFrame:
        """Points joined with the ranges they lie in."""
        end = F.when(open_end, F.lit(len(cuts)).cast("long")).otherwise(bucket(hi))
        placed = ranges.withColumn("_p", F.explode(places(bucket(lo), end))).select(*ranges.columns, "_p.*")
        levels = max(1, len(cuts).bit_length())
        at = points.withColumn("_b", bucket(point))
        at = at.withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(levels)))).withColumn("block", F.call_function("shiftright", F.col("_b"), F.greatest("level", F.lit(0)))).drop("_b")
        inside = (lo <= point) & (open_end | (hi >= point))
        return at.join(placed, ["level", "block"]).where(inside).drop("level", "block")

    begun = within(events, subscriptions, F.col("lower"), F.col("upper"), F.col("key"), F.length("upper") == 0)
    if last == "key":
        return begun
    # The subscription begins inside of the event, behind its first key.
    later = within(subscriptions, events, F.col("key"), F.col(last), F.col("lower"), F.lit(False)).where(F.col("lower") > F.col("key"))
    return begun.unionByName(later.select(begun.columns))


def point_events(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """listener_id and event of every put and delete whose key lies in a subscription (listener_id, lower, upper).

    Nothing is dropped, however full a listener's buffer would be.
    """
    events = log.where("op_type in (0, 1) and key is not null").select("seq_id", "op_type", "key", "value")
    is_put = F.col("op_type") == 0
    return _meet(events, subscriptions, "key").select("listener_id", "seq_id", F.when(is_put, "PUT").otherwise("DELETE").alias("type"), "key", F.when(is_put, F.col("value")).alias("value"))


def range_events(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """listener_id and event of every range delete that overlaps a subscription."""
    events = log.where("op_type = 3 and key <= value").select("seq_id", "key", "value")
    return _meet(events, subscriptions, "value").select("listener_id", "seq_id", F.lit("RANGEDEL").alias("type"), "key", "value")


def delivered(events: DataFrame, buffer_size: int) -> DataFrame:
    """The first events of each listener that a buffer nobody empties would hold; the option for callers that want drops."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy("listener_id").orderBy("seq_id"))).where(F.col("_n") <= buffer_size).drop("_n")
