"""Rebuilding the current rows of a table from a feed of inserts, updates and deletes.

A signed multiset: every distinct change adds its own after-image (+1) and takes away the
image that was there before it (-1); a delete's after-image is a tombstone. The signs of each
image are summed with the base, what stays positive is the current state, and tombstones are
dropped at the end. Order of arrival and repetition don't matter, as images are ordered by
sequence id and copies are removed first.

The sums are taken twice: within stretches of the sequence, so that a key with very many
changes is worked on by many tasks, and then over what each stretch left.

Nulls: a change without key columns, sequence id or known operation is none. Two changes of
one key and sequence id count once; if one of them deletes, the delete counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL, PUT, RANGEDEL, is_reserved
from siltbed.operators.cover import uncovered
from siltbed.session import scratch, settle

#: Length of a stretch of the sequence.
STRETCH = 65_536


def _images(changes: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Sum the signed images of each group; one image (key columns, seq_id, op_type) is left per group."""
    in_order = Window.partitionBy(*group).orderBy("seq_id")
    before = F.struct(F.lag("seq_id").over(in_order).alias("seq_id"), F.lag("op_type").over(in_order).alias("op_type"), F.lit(-1).alias("sign"))
    after = F.struct("seq_id", "op_type", F.lit(1).alias("sign"))
    signed = changes.select(*group, after.alias("after"), before.alias("before")).select(*group, F.explode(F.array("after", "before")).alias("image"))
    signed = signed.select(*group, "image.seq_id", "image.op_type", "image.sign").where("seq_id is not null")
    left = signed.groupBy(*group, "seq_id").agg(F.sum("sign").alias("n"), F.max("op_type").alias("op_type")).where("n > 0")
    return left.select(*keys, "seq_id", "op_type")


def current_images(changes: DataFrame, keys: list[str], base: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """The image that stands for each key at the end: key columns, seq_id, op_type (PUT or DEL).

    changes: key columns, seq_id long, op_type (PUT, DEL; others are ignored). base: key
    columns and seq_id of rows that were there before; a change older than its base row has no effect.
    """
    known = changes.where(" and ".join(f"{k} is not null" for k in [*keys, "seq_id"])).where(F.col("op_type").isin(PUT, DEL))
    distinct = known.groupBy(*keys, "seq_id").agg(F.max("op_type").alias("op_type"))
    stretches = distinct.withColumn("stretch", F.floor(F.col("seq_id") / stretch))
    left = _images(stretches, [*keys, "stretch"], keys)
    if base is not None:
        left = left.unionByName(base.select(*keys, "seq_id", F.lit(PUT).cast(left.schema["op_type"].dataType).alias("op_type")))
    return _images(left, keys, keys)


def current_keys(effective: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The live keys of each store with the sequence id of the put that supplies the value: store_id, key, seq_id.

    effective: store_id, seq_id, op_type, key, value of the records that take effect. A range
    delete takes away every row of lower seq_id from key to value, both inclusive. Merge
    records and reserved keys are left out.
    """
    spark = effective.sparkSession
    put = current_images(effective.where(~is_reserved(F.col("key"))).select("store_id", "key", "seq_id", "op_type"), ["store_id", "key"], base)
    put = put.where(F.col("op_type") == PUT)
    points = settle(put.select(F.col("store_id").cast("long").alias("space"), "key", "seq_id"), scratch(spark, "points"))
    ranges = effective.where(F.col("op_type") == RANGEDEL)
    ranges = ranges.select(F.col("store_id").cast("long").alias("space"), F.col("key").alias("lo"), F.col("value").alias("hi"), "seq_id")
    left = uncovered(points, settle(ranges, scratch(spark, "ranges")))
    return left.select(F.col("space").cast(effective.schema["store_id"].dataType).alias("store_id"), "key", "seq_id")
