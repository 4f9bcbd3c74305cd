"""Token buckets: a fixed number of calls per interval, counted from the last refill.

Each decision depends on the refill before it, so a bucket is folded in order. Rows stream past
in sorted order and only the state of the present bucket is held; the group is never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltbed.session import ship


def step(tokens: int, refilled: int | None, at: int, most: int, interval: int) -> tuple[int, int, bool]:
    """Tokens left, time of the last refill, and whether the call at that time is admitted."""
    if refilled is None or at - refilled >= interval:
        tokens, refilled = most, at
    return (tokens - 1, refilled, True) if tokens > 0 else (tokens, refilled, False)


def admissions(calls: DataFrame, max_tokens: int, interval_ms: int) -> DataFrame:
    """bucket string, call_id, at_ms, admitted of each call (bucket string, call_id long, at_ms long).

    Calls of equal time are taken by call_id. Calls without a time or bucket are left out.
    """

    ship(calls.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tokens, refilled = None, 0, None
        for batch in batches:
            admitted = []
            for b, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if b != bucket:
                    bucket, tokens, refilled = b, 0, None
                tokens, refilled, ok = step(tokens, refilled, at, max_tokens, interval_ms)
                admitted.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(admitted, pa.bool_())], ["bucket", "call_id", "at_ms", "admitted"])

    ordered = calls.select("bucket", "call_id", "at_ms").where("bucket is not null and at_ms is not null").repartition("bucket").sortWithinPartitions("bucket", "at_ms", "call_id")
    return ordered.mapInArrow(fold, "bucket string, call_id long, at_ms long, admitted boolean")
