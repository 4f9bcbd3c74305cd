"""The streaming forms give what the batch forms give."""

import random
from datetime import datetime

import pytest

from siltbed.operators import bucket, changes, notify
from siltbed.session import scratch
from siltbed.sources.store import effective
from siltbed.streaming import admission, expiry, references, state
from siltbed.streaming.versions import Versions

LOG = "store_id int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long, at timestamp"


def feed(spark, batches, schema):
    """A stream that delivers each list of rows as one batch."""
    path = scratch(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch(spark, "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def at(seconds):
    return datetime.fromtimestamp(1_700_000_000 + seconds)


CHANGE = "store_id int, seq_id long, op_type byte, key binary, value binary, txn_id long, rec_type byte"


@pytest.mark.parametrize("seed", [1, 2])
def test_state_is_maintained(spark, seed):
    """Any order and split of puts, deletes, range deletes, transactions and repetitions gives the batch operator's rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(1, 70):
        op = rnd.choice([0, 0, 0, 1, 2, 3])
        txn = rnd.choice([None, None, 7, 8, 9])
        rows.append((rnd.choice([1, 1, 2]), i, op, rnd.choice([b"a", b"b", b"c", b"d", b"\x01s", b"", None]), rnd.choice([b"b", b"c", b"d", b"\xff", None]), txn, 0 if txn is None else 2))
    rows += [(s, 60, 0, b"", None, t, 3) for s, t in ((1, 7), (2, 8), (1, 9))] + rnd.sample(rows, 9)
    rnd.shuffle(rows)
    versions = Versions(spark, scratch(spark, "versions"), buckets=4)
    state.maintain(feed(spark, [rows[:20], rows[20:40], rows[40:]], CHANGE), versions, scratch(spark, "check")).awaitTermination(300)
    want = changes.current_keys(effective(spark.createDataFrame(rows, CHANGE)))
    assert sorted((r.store_id, bytes(r.key), r.seq_id) for r in state.live(versions).collect()) == sorted((r.store_id, bytes(r.key), r.seq_id) for r in want.collect())
    versions.vacuum(1)
    assert state.live(versions).count() == want.count()


def test_notifications(spark):
    subs = spark.createDataFrame([(1, b"a", b"c"), (2, b"", b"b")], "listener_id long, lower binary, upper binary")
    got = collect(spark, notify.point_events(feed(spark, [[(1, 1, 0, b"b", b"1", None, at(0))], [(1, 2, 1, b"c", None, None, at(0))]], LOG), subs), "told")
    assert sorted((r.listener_id, r.seq_id, r.type) for r in got) == [(1, 1, "PUT"), (1, 2, "DELETE"), (2, 1, "PUT")]


def test_expiry(spark):
    ms = lambda s: (1_700_000_000 + s) * 1000
    batches = [
        [(1, 1, 0, b"short", b"", ms(5), at(0)), (1, 2, 0, b"replaced", b"", ms(5), at(0)), (1, 3, 0, b"long", b"", ms(9999), at(0))],
        [(1, 4, 0, b"replaced", b"", None, at(1))],
        [(1, 5, 0, b"tick", b"", None, at(100))],
        [(1, 6, 0, b"tick", b"", None, at(200))],
    ]
    got = collect(spark, expiry.expiry_events(feed(spark, batches, LOG), "at", "1 second"), "expired")
    assert [(bytes(r.key), r.seq_id) for r in got] == [(b"short", 1)]


def test_admissions(spark):
    calls = [("a", i, i * 10) for i in range(40)] + [("b", 100 + i, i * 33) for i in range(10)]
    schema = "bucket string, call_id long, at_ms long"
    batch = {r.call_id: r.admitted for r in bucket.admissions(spark.createDataFrame(calls, schema), 2, 100).collect()}
    parts = [[c for c in calls if c[2] < 150], [c for c in calls if 150 <= c[2] < 300], [c for c in calls if c[2] >= 300]]
    got = {r.call_id: r.admitted for r in collect(spark, admission.admissions(feed(spark, parts, schema), 2, 100), "admitted")}
    assert got == batch


def test_references(spark):
    schema = "ref_table string, store_id int, target string, at long, ref_id long, delta int"
    batches = [
        [("t", 1, "x", 10, 1, None), ("t", 1, "y", 10, None, 1), ("t", 1, "y", 11, 2, None)],
        [("t", 1, "x", 20, None, 1), ("t", 1, "x", 21, 3, None)],
        [("t", 1, "y", 30, None, -1), ("t", 1, "y", 31, 4, None)],
        [("t", 1, "x", 5, None, 1), ("t", 1, "y", 10, None, -1)],
    ]
    versions = Versions(spark, scratch(spark, "versions"), buckets=4)
    references.watch(feed(spark, batches, schema), versions, scratch(spark, "check"), slice_micros=5).awaitTermination(300)
    told = [sorted((r.ref_id, r.change) for r in versions.read(n, "changes").collect()) for n in range(4)]
    # What came late resolves the first reference and reopens the second.
    assert told == [[(1, 1)], [], [(4, 1)], [(1, -1), (2, 1)]]
    assert sorted(r.ref_id for r in references.orphans(versions).collect()) == [2, 4]
    assert {r.ref_table: r.open for r in references.open_references(versions).collect()} == {"t": 2}
