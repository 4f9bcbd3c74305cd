"""A delete event for each key at the time its newest version expires, on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltbed.session import ship

_OUT = "store_id int, key binary, seq_id long, expires_at_ms long"
_STATE = "seq_id long, expires_at_ms long"


def _newest(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store, key = group
    seq, expires = state.get if state.exists else (-1, 0)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(store, key, seq, expires)], columns=["store_id", "key", "seq_id", "expires_at_ms"])
        return
    for batch in batches:
        at = batch["seq_id"].idxmax()
        if batch.at[at, "seq_id"] > seq:
            seq = int(batch.at[at, "seq_id"])
            expires = 0 if batch.at[at, "op_type"] != 0 or pd.isna(batch.at[at, "expires_at_ms"]) else int(batch.at[at, "expires_at_ms"])
    state.update((seq, expires))
    if expires and expires <= state.getCurrentWatermarkMs():
        state.remove()
        yield pd.DataFrame([(store, key, seq, expires)], columns=["store_id", "key", "seq_id", "expires_at_ms"])
    elif expires:
        state.setTimeoutTimestamp(expires)


def expiry_events(log: DataFrame, at: str, late: str) -> DataFrame:
    """store_id, key, seq_id, expires_at_ms of each expiry the watermark has passed.

    log: store_id, key, seq_id, op_type, expires_at_ms and the event time `at`. A newer
    version of a key replaces the timer of the older one, so it expires silently.
    """
    ship(log.sparkSession)
    rows = log.withWatermark(at, late).where("op_type in (0, 1)").select(F.col("store_id").cast("int"), "key", "seq_id", "op_type", "expires_at_ms", at)
    return rows.groupBy("store_id", "key").applyInPandasWithState(_newest, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
