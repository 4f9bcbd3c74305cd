"""Backup lineage: chains of bases, what a restore needs, what depends on what.

Rows of one store and id are one backup; the last recorded counts. Blank bases are none. A base that
does not exist ends the chain; circles are followed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch, settle

ID = ["store_id", "id"]


def distinct_backups(backups: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(*ID).orderBy(F.col("recorded_at").desc(), F.col("backup_no").desc()))
    base = F.nullif(F.trim("base_id"), F.lit(""))
    return backups.where("id is not null").withColumn("base_id", base).withColumn("n", last).where("n = 1").drop("n")


def ancestors(backups: DataFrame) -> DataFrame:
    """Every backup with each one it builds on, directly or not, and with itself: store_id, id, ancestor.

    Pairs are squared, so a chain of n takes log2(n) steps.
    """
    spark = backups.sparkSession
    links = backups.where("base_id is not null").select(*ID, F.col("base_id").alias("ancestor"))
    real = links.join(backups.select("store_id", F.col("id").alias("ancestor")), ["store_id", "ancestor"], "left_semi").select(*ID, "ancestor")
    reach = settle(real.unionByName(backups.select(*ID, F.col("id").alias("ancestor"))).distinct(), scratch(spark, "lineage"))
    size = reach.count()
    while True:
        onward = reach.select("store_id", F.col("id").alias("ancestor"), F.col("ancestor").alias("further"))
        reach = settle(reach.join(onward, ["store_id", "ancestor"]).select(*ID, F.col("further").alias("ancestor")).distinct(), scratch(spark, "lineage"))
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def file_names(files: DataFrame, column: str) -> DataFrame:
    """store_id, id, file: last path components of an array column."""
    return files.select(*ID, F.explode(column).alias("f")).select(*ID, F.substring_index("f", "/", -1).alias("file")).where("trim(file) != ''").distinct()


def incremental_files(backups: DataFrame) -> DataFrame:
    """Files of each backup that none of its bases holds: store_id, id, file."""
    own = file_names(backups, "files")
    chain = ancestors(backups).where("id != ancestor")
    held = chain.join(own.select("store_id", F.col("id").alias("ancestor"), "file"), ["store_id", "ancestor"]).select(*ID, "file")
    return own.join(held, [*ID, "file"], "left_anti")


def restore_set(backups: DataFrame) -> DataFrame:
    """Files a restore of each backup writes, each from the newest backup of its chain that holds it: store_id, id, file, from_id."""
    own = file_names(backups, "files").join(backups.select(*ID, "ts"), ID).select("store_id", F.col("id").alias("ancestor"), "file", "ts")
    every = ancestors(backups).join(own, ["store_id", "ancestor"])
    return every.groupBy(*ID, "file").agg(F.max(F.struct("ts", "ancestor")).alias("s")).select(*ID, "file", F.col("s.ancestor").alias("from_id"))


def cascade(backups: DataFrame) -> DataFrame:
    """What a cascading delete of each backup removes besides it: store_id, id, dependent."""
    return ancestors(backups).where("id != ancestor").select("store_id", F.col("ancestor").alias("id"), F.col("id").alias("dependent"))
