"""Versions of keys: history, the n-th newest, differences, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL
from siltbed.operators.ordered import numbered
from siltbed.operators.resolve import versions

KEY = ["store_id", "key"]


def history(effective: DataFrame) -> DataFrame:
    """Every version that is no delete, with version 0 the newest; range deletes and expiry don't apply to history."""
    return numbered(versions(effective).where(F.col("op_type") != DEL), KEY, [F.col("seq_id").desc()], "version")


def newest_versions(effective: DataFrame, most: int) -> DataFrame:
    """The newest versions of each key; ranks are cut before the exchange, so a hot key costs a few rows per task."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("seq_id").desc()))
    return versions(effective).where(F.col("op_type") != DEL).withColumn("version", (rank - 1).cast("long")).where(F.col("version") < most)


def differences(effective: DataFrame) -> DataFrame:
    """Each version with the sequence id and value of the one before it, joined by number."""
    each = history(effective)
    older = each.select(*KEY, (F.col("version") - 1).alias("version"), F.col("seq_id").alias("old_seq"), F.col("value").alias("old_value"))
    return each.join(older, [*KEY, "version"], "left")


def kept_by_snapshots(effective: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Versions that snapshots (store_id, key, since_seq) keep: the one that was current then, and all later ones."""
    each = versions(effective).join(snapshots, KEY)
    base = each.where("seq_id <= since_seq").groupBy(*KEY, "since_seq").agg(F.max("seq_id").alias("base_seq"))
    return each.join(base, [*KEY, "since_seq"], "left").where("seq_id > since_seq or seq_id = base_seq").drop("base_seq")
