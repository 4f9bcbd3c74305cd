"""Current keys, kept up to date by a stream of log records in any order.

What is kept: the newest image of each key, deletes included, so that a put that comes late stays dead; all
range deletes; records of transactions whose commit hasn't come, and the commits. Only the buckets that a batch touches
are read and written. live() gives what the batch operator changes.current_keys() gives for all records seen.

Nulls: as in changes.current_keys(); a transaction's record without a number never takes effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.functions.columns import COMMIT, DEL, PUT, RANGEDEL, SINGLE, TXN, is_reserved
from siltbed.operators.changes import current_images
from siltbed.operators.cover import uncovered
from siltbed.session import scratch, settle
from siltbed.streaming.versions import Versions

_IMAGE = "store_id int, key binary, seq_id long, op_type byte"
_RANGE = "store_id int, key binary, value binary, seq_id long"
_TXN = "store_id int, txn_id long"
_PENDING = f"{_TXN}, key binary, seq_id long, op_type byte, value binary"


def fold(batch: DataFrame, number: int, versions: Versions) -> None:
    """Make version number of the version before and a batch (store_id, key, seq_id, op_type, value, txn_id, rec_type)."""
    spark, last = batch.sparkSession, versions.before(number)
    kinds = {c.split()[0]: c.split()[1] for c in f"{_PENDING}, rec_type byte".split(", ")}
    batch = settle(batch.select(*(F.col(c).cast(kind) for c, kind in kinds.items())), scratch(spark, "batch"))
    by_txn = batch.where(F.col("rec_type").isin(TXN, COMMIT) & F.col("store_id").isNotNull() & F.col("txn_id").isNotNull())
    txns = versions.touched(by_txn, ["store_id", "txn_id"])
    commits = versions.keyed(last, "commits", _TXN, txns).unionByName(by_txn.where(F.col("rec_type") == COMMIT).select("store_id", "txn_id")).distinct()
    columns = [c.split()[0] for c in _PENDING.split(", ")]
    waiting = settle(versions.keyed(last, "pending", _PENDING, txns).unionByName(by_txn.where(F.col("rec_type") == TXN).select(*columns)), scratch(spark, "waiting"))
    commits = settle(commits, scratch(spark, "commits"))
    ready = waiting.join(commits, ["store_id", "txn_id"], "left_semi")
    rows = settle(batch.where(F.col("rec_type") == SINGLE).select(*columns).unionByName(ready.select(*columns)), scratch(spark, "ready"))

    points = rows.where(F.col("op_type").isin(PUT, DEL) & F.col("store_id").isNotNull() & F.col("key").isNotNull() & F.col("seq_id").isNotNull()).select("store_id", "key", "seq_id", "op_type")
    mine = versions.touched(points, ["store_id", "key"])
    images = current_images(points.unionByName(versions.keyed(last, "images", _IMAGE, mine)), ["store_id", "key"])
    wide = rows.where((F.col("op_type") == RANGEDEL) & F.col("store_id").isNotNull() & F.col("seq_id").isNotNull()).where("key <= value").select("store_id", "key", "value", "seq_id")
    spans = versions.touched(wide, ["store_id", "key"])
    ranges = versions.keyed(last, "ranges", _RANGE, spans).unionByName(wide).groupBy("store_id", "key", "value").agg(F.max("seq_id").alias("seq_id"))
    pending = waiting.join(commits, ["store_id", "txn_id"], "left_anti").select(*columns).distinct()
    by_key, by_id = ["store_id", "key"], ["store_id", "txn_id"]
    versions.write(number, {"images": (images, by_key, mine), "ranges": (ranges, by_key, spans), "commits": (commits, by_id, txns), "pending": (pending, by_id, txns)})


def maintain(log: DataFrame, versions: Versions, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold each batch of records into the version before."""
    stream = log.writeStream.foreachBatch(lambda batch, number: fold(batch, number, versions))
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(versions: Versions) -> DataFrame:
    """store_id, key, seq_id of each live key; reserved keys are left out."""
    last = versions.before(1 << 62)
    put = versions.keyed(last, "images", _IMAGE).where((F.col("op_type") == PUT) & ~is_reserved(F.col("key")))
    points = put.select(F.col("store_id").cast("long").alias("space"), "key", "seq_id")
    ranges = versions.keyed(last, "ranges", _RANGE).select(F.col("store_id").cast("long").alias("space"), F.col("key").alias("lo"), F.col("value").alias("hi"), "seq_id")
    return uncovered(points, ranges).select(F.col("space").cast("int").alias("store_id"), "key", "seq_id")
