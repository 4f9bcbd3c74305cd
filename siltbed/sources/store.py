"""The store's tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.columns import COMMIT, SINGLE, TXN, last_component, micros, name_stems, not_blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference between the tables: ref_table, ref_id, store_id, target, at (microseconds)."""
    manifest, wal, backups, oplog = (table(spark, sf_dir, t) for t in ("sstable_manifest", "wal_manifest", "backups", "oplog"))

    def of(df: DataFrame, name: str, ref_id: str, target, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(ref_id).alias("ref_id"), "store_id", target.alias("target"), micros(F.col(at)).alias("at"))

    return (
        of(manifest.where(not_blank(F.col("base_file_name"))), "sstable_manifest", "entry_id", last_component(F.col("base_file_name")), "added_at")
        .unionByName(of(wal.where("segment_id is not null"), "wal_manifest", "entry_id", F.format_string("wal_%06d.log", F.col("segment_id")), "added_at"))
        .unionByName(of(backups.where(not_blank(F.col("base_id"))), "backups", "backup_no", F.trim("base_id"), "recorded_at"))
        .unionByName(of(oplog.where("segment_id is not null"), "oplog", "delivery_id", F.col("segment_id").cast("string"), "arrived_at"))
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be referred to: ref_table, store_id, target, starts, ends (microseconds)."""
    files, wal, backups = (table(spark, sf_dir, t) for t in ("store_files", "wal_manifest", "backups"))

    def of(df: DataFrame, name: str, target, starts: str, ends: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), "store_id", target.alias("target"), micros(F.col(starts)).alias("starts"), micros(F.col(ends)).alias("ends"))

    return (
        of(files.where("dir = 'data'"), "sstable_manifest", F.explode(name_stems(F.col("file_name"))), "created_at", "deleted_at")
        .unionByName(of(files.where("dir = 'wal'"), "wal_manifest", F.col("file_name"), "created_at", "deleted_at"))
        .unionByName(of(backups, "backups", F.col("id"), "recorded_at", "deleted_at"))
        .unionByName(of(wal, "oplog", F.col("segment_id").cast("string"), "added_at", "deleted_at"))
    )


def effective(oplog: DataFrame) -> DataFrame:
    """The records that take effect: single ones, and those of a transaction whose commit arrived, whenever that was."""
    commits = oplog.where(F.col("rec_type") == COMMIT).select("store_id", "txn_id").distinct()
    return oplog.where(F.col("rec_type") == SINGLE).unionByName(oplog.where(F.col("rec_type") == TXN).join(commits, ["store_id", "txn_id"], "left_semi").select(oplog.columns))
