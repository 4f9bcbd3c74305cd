"""Batches, transactions and replay of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.columns import COMMIT, DEL, PUT, SINGLE, TXN, is_reserved
from siltbed.sources.store import effective

TXN_ID = ["store_id", "txn_id"]


def transactions(oplog: DataFrame) -> DataFrame:
    """Per transaction: distinct records, bounds of the sequence, and whether its commit arrived."""
    rows = oplog.where("txn_id is not null and store_id is not null").select(*TXN_ID, "seq_id", "rec_type").distinct()
    record = F.when(F.col("rec_type") == TXN, F.col("seq_id"))
    return rows.groupBy(*TXN_ID).agg(
        F.countDistinct(record).alias("records"), F.min(record).alias("first_seq"), F.max(record).alias("last_seq"),
        (F.count_if(F.col("rec_type") == COMMIT) > 0).alias("committed"),
    )


def batches(oplog: DataFrame, op: int) -> DataFrame:
    """Committed transactions of one operation only, whose keys are all allowed: store_id, txn_id, records, first_seq, last_seq."""
    rows = effective(oplog.where("txn_id is not null")).where(F.col("rec_type") == TXN).select(*TXN_ID, "seq_id", "op_type", "key").distinct()
    wrong = (F.col("op_type") != op) | (F.length("key") == 0) | is_reserved(F.col("key")) | F.col("key").isNull()
    whole = rows.groupBy(*TXN_ID).agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("records"), F.min("seq_id").alias("first_seq"), F.max("seq_id").alias("last_seq"))
    return whole.where("wrong = 0").drop("wrong")


def watermarks(wal_manifest: DataFrame) -> DataFrame:
    """The highest flushed sequence id among each store's entries that are there: store_id, watermark."""
    return wal_manifest.where("deleted_at is null").groupBy("store_id").agg(F.max("flushed_up_to_seq_id").alias("watermark"))


def replay(oplog: DataFrame, wal_manifest: DataFrame) -> DataFrame:
    """Distinct records that take effect behind the watermark; commits are decided before it is applied."""
    rows = effective(oplog).select("store_id", "seq_id", "op_type", "key", "rec_type").distinct()
    marks = watermarks(wal_manifest)  # a row a store
    return rows.join(F.broadcast(marks), "store_id", "left").where("seq_id > coalesce(watermark, -1)").drop("watermark")


def segments(oplog: DataFrame, wal_manifest: DataFrame) -> DataFrame:
    """Per segment of the log: deliveries, bounds of the sequence, and whether it may be deleted, as all of it is flushed."""
    each = oplog.where("segment_id is not null and store_id is not null").groupBy("store_id", "segment_id")
    each = each.agg(F.count("*").alias("deliveries"), F.min("seq_id").alias("min_seq"), F.max("seq_id").alias("max_seq"))
    marks = watermarks(wal_manifest)  # a row a store
    return each.join(F.broadcast(marks), "store_id", "left").withColumn("deletable", F.coalesce(F.col("max_seq") <= F.col("watermark"), F.lit(False))).drop("watermark")


def append_batch(spark, path: str, rows: list[tuple[bytes, bytes | None]], op: int, store_id: int, first_seq: int, txn_id: int | None) -> int:
    """Append puts or deletes as one atomic write of one file; returns the next sequence id. Empty and reserved keys refuse the whole batch."""
    if op not in (PUT, DEL):
        raise ValueError("a batch puts or deletes")
    for key, _ in rows:
        if not key or key[0] == 1:
            raise ValueError("empty and reserved keys can't be written")
    kind = SINGLE if txn_id is None else TXN
    data = [(store_id, first_seq + i, op, bytes(k), v, None, txn_id, kind) for i, (k, v) in enumerate(rows)]
    if txn_id is not None:
        data.append((store_id, first_seq + len(rows) - 1, PUT, b"", None, None, txn_id, COMMIT))
    schema = "store_id int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long, txn_id long, rec_type byte"
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return first_seq + len(rows)
