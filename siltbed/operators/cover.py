"""Which range of highest sequence id covers a point of a key space? An interval join without a nested loop.

Key space and points are cut into buckets at sampled keys (any cut is right; the sample only
balances). A range enters the buckets of its two ends; the buckets between are covered whole,
so only the highest sequence id counts there and is aggregated over a tree of bucket blocks
first. Within a bucket, rows come in key order and a heap of active ranges streams past them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import ship

#: Rows a bucket should have, most buckets, and most sampled keys that go to the driver.
ROWS_PER_BUCKET, MOST_BUCKETS, MOST_SAMPLED = 20_000, 4096, 65_536

_RANGES = "space long, bucket long, level int, lo binary, hi binary, seq_id long"
_SWEPT = "bucket long, space long, key binary, hi binary, seq_id long, is_point boolean"


def _blocks(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The fewest aligned blocks (level, index) of 2**level buckets that make up lo..hi-1."""
    level = 0
    while lo < hi:
        if lo & 1:
            yield level, lo
            lo += 1
        if hi & 1:
            hi -= 1
            yield level, hi
        lo, hi, level = lo >> 1, hi >> 1, level + 1


def sample_cuts(keys: DataFrame) -> list[tuple[int, bytes]]:
    """Places (space, key) that cut keys (space long, key) into buckets of about equal size, from a bounded sample by hash."""
    n = keys.count()
    buckets = min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET))
    if buckets < 2:
        return []
    sampled = keys.where(F.pmod(F.xxhash64("space", "key"), F.lit(max(1, n * 2 // MOST_SAMPLED))) == 0).limit(MOST_SAMPLED)
    found = sorted({(r.space, bytes(r.key)) for r in sampled.toLocalIterator()})
    return found[:: max(1, len(found) // buckets)][1:]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, space and key, ranges before points of the same key; yields the points with the highest range over them."""
    at, active = None, []
    for batch in batches:
        points: list[int] = []
        cover: list[int | None] = []
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for i, (bucket, space, key, hi, seq, is_point) in enumerate(zip(*cols)):
            if (bucket, space) != at:
                at, active = (bucket, space), []
            if not is_point:
                heapq.heappush(active, (-seq, hi))
                continue
            while active and active[0][1] is not None and active[0][1] < key:
                heapq.heappop(active)
            points.append(i)
            cover.append(-active[0][0] if active else None)
        left = batch.take(pa.array(points, pa.int64()))
        yield pa.RecordBatch.from_arrays([left.column(1), left.column(2), left.column(4), pa.array(cover, pa.int64())], ["space", "key", "seq_id", "cover_seq"])


def covering(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The points (space long, key, seq_id) with cover_seq, the highest seq_id of a range (space long, lo, hi, seq_id) over them; both ends are inclusive.

    Rows with a null in any of these columns are no points and no ranges; a range whose end
    precedes its beginning covers nothing. Both inputs are read twice, so they should be
    cheap to read. Repeated points come out as often as they went in.
    """
    ship(points.sparkSession)
    points = points.select("space", "key", "seq_id").where("space is not null and key is not null and seq_id is not null")
    ranges = ranges.select("space", "lo", "hi", "seq_id").where("space is not null and seq_id is not null and lo <= hi")
    ranges = ranges.groupBy("space", "lo", "hi").agg(F.max("seq_id").alias("seq_id"))
    cuts = sample_cuts(points.select("space", "key").unionByName(ranges.select("space", F.col("lo").alias("key"))))

    @F.pandas_udf(T.LongType())
    def bucket_of(space, key):
        import pandas as pd

        return pd.Series([bisect_right(cuts, (s, k)) for s, k in zip(space, key)], dtype="int64")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for space, lo, hi, seq in zip(*(batch.column(i).to_pylist() for i in range(4))):
                first, last = bisect_right(cuts, (space, lo)), bisect_right(cuts, (space, hi))
                rows += [(space, b, None, lo, hi, seq) for b in {first, last}]
                rows += [(space, i, level, None, None, seq) for level, i in _blocks(first + 1, last)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["space", "bucket", "level", "lo", "hi", "seq_id"])

    parts = ranges.mapInArrow(placed, _RANGES)
    ends = parts.where("level is null").select("bucket", "space", F.col("lo").alias("key"), "hi", "seq_id")
    whole = parts.where("level is not null").groupBy("space", "level", "bucket").agg(F.max("seq_id").alias("seq_id"))
    block = F.expr("sequence(bucket << level, ((bucket + 1) << level) - 1)")
    whole = whole.select("space", F.explode(block).alias("bucket"), "seq_id").groupBy("space", "bucket").agg(F.max("seq_id").alias("seq_id"))
    whole = whole.select("bucket", "space", F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("hi"), "seq_id")
    swept = (
        ends.unionByName(whole).withColumn("is_point", F.lit(False))
        .unionByName(points.select(bucket_of("space", "key").alias("bucket"), "space", "key", F.lit(None).cast("binary").alias("hi"), "seq_id", F.lit(True).alias("is_point")))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "space", "key", "is_point")
        .select("bucket", "space", "key", "hi", "seq_id", "is_point")
    )
    return swept.mapInArrow(_sweep, "space long, key binary, seq_id long, cover_seq long")


def uncovered(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The points that no range of higher seq_id covers; see covering()."""
    return covering(points, ranges).where("cover_seq is null or cover_seq <= seq_id").drop("cover_seq")
