"""Range, prefix and paged scans over resolved rows.

Bounds are inclusive; an empty bound is open. Pages are numbered from 0; a negative page is page 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.columns import MERGE
from siltbed.operators import resolve
from siltbed.operators.ordered import last_before, numbered


def in_range(key: Column, lower: bytes, upper: bytes) -> Column:
    fits = F.lit(True)
    if lower:
        fits &= key >= F.lit(lower)
    if upper:
        fits &= key <= F.lit(upper)
    return fits


def range_scan(rows: DataFrame, lower: bytes, upper: bytes) -> DataFrame:
    return rows.where(in_range(F.col("key"), lower, upper))


def prefix_scan(rows: DataFrame, prefix: bytes) -> DataFrame:
    """Keys that begin with prefix; the bounds let the scan skip row groups, as startswith does for text."""
    return rows.where((F.col("key") >= F.lit(prefix)) & (F.substring("key", 1, len(prefix)) == F.lit(prefix)))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page in key order: a top-k of the partitions, never a full sort."""
    if size <= 0:
        raise ValueError("a page needs a size above 0")
    return rows.orderBy("key").offset(max(0, number) * size).limit(size)


def store_pages(rows: DataFrame, number: int, size: int) -> DataFrame:
    """The same page of every store; ranks are cut before the exchange, so a task sends a store's first rows only."""
    if size <= 0:
        raise ValueError("a page needs a size above 0")
    first = max(0, number) * size
    rank = F.row_number().over(Window.partitionBy("store_id").orderBy("key"))
    return rows.withColumn("_n", rank).where((F.col("_n") > first) & (F.col("_n") <= first + size)).drop("_n")


def page_directory(rows: DataFrame, size: int) -> DataFrame:
    """Of each store's pages: store_id, page, first_key, last_key, rows, top_seq."""
    if size <= 0:
        raise ValueError("a page needs a size above 0")
    placed = numbered(rows.select("store_id", "key", "seq_id"), ["store_id"], [F.col("key").asc()], "n").withColumn("page", F.floor(F.col("n") / size))
    return placed.groupBy("store_id", "page").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("rows"), F.max("seq_id").alias("top_seq"))


def dirty_pages(effective: DataFrame, as_of: int, size: int) -> DataFrame:
    """Pages of the state at a sequence id: store_id, page, changed_keys, dirty.

    changed_keys counts keys with a later put or delete between a page's first and last key. A page is dirty by these, and
    by a later range delete that overlaps it: one that begins within the page or is over its first key.
    """
    pages = page_directory(resolve.state(effective, as_of=as_of), size)
    events = resolve.versions(effective).where((F.col("seq_id") > as_of) & (F.col("op_type") != MERGE)).select("store_id", "key").distinct()
    later = resolve.tombstones(effective).where(F.col("seq_id") > as_of)
    starts = later.select("store_id", F.col("start_key").alias("key")).distinct()
    heads = pages.select("store_id", F.col("first_key").alias("key"), F.lit(0).alias("kind"), F.struct("page", "last_key").alias("head"))
    none = F.lit(None).cast(heads.schema["head"].dataType).alias("head")
    rows = heads.unionByName(events.select("store_id", "key", F.lit(1).alias("kind"), none)).unionByName(starts.select("store_id", "key", F.lit(2).alias("kind"), none))
    placed = last_before(rows, ["store_id"], ["key", "kind"], F.col("head"), "at").where("kind > 0 and key <= at.last_key")
    hit = placed.groupBy("store_id", F.col("at.page").alias("page")).agg(F.count_if(F.col("kind") == 1).alias("changed_keys"), F.count_if(F.col("kind") == 2).alias("begin"))
    firsts = pages.select("store_id", "page", F.col("first_key").alias("key"), F.lit(as_of).cast("long").alias("seq_id"))
    each = resolve.with_cover(firsts, later).join(hit, ["store_id", "page"], "left").na.fill(0, ["changed_keys", "begin"])
    return each.select("store_id", "page", "changed_keys", ((F.col("changed_keys") > 0) | (F.col("begin") > 0) | F.col("cover_seq").isNotNull()).alias("dirty"))


def iterate(rows: DataFrame):
    """Rows in key order, one partition at a time on the driver."""
    return rows.orderBy("key").toLocalIterator(prefetchPartitions=True)
