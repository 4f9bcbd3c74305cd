"""Token buckets on a stream: admitted or not, in the order of time within each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltbed.operators.bucket import step
from siltbed.session import ship


def admissions(calls: DataFrame, max_tokens: int, interval_ms: int) -> DataFrame:
    """bucket, call_id, at_ms, admitted; the state of a bucket is its tokens and last refill."""

    ship(calls.sparkSession)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, refilled = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "call_id"])
        admitted = []
        for at in rows["at_ms"]:
            tokens, refilled, ok = step(tokens, refilled, int(at), max_tokens, interval_ms)
            admitted.append(ok)
        state.update((tokens, refilled))
        yield rows[["bucket", "call_id", "at_ms"]].assign(admitted=admitted)

    return calls.groupBy("bucket").applyInPandasWithState(
        fold, "bucket string, call_id long, at_ms long, admitted boolean", "tokens int, refilled long", "append", GroupStateTimeout.NoTimeout
    )
