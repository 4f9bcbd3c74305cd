"""The four operators over the store's tables against plain Python, with dirty, empty and repeated input."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltbed.operators import changes, newonly, orphans, smallfiles
from siltbed.session import scratch

REF = "ref_table string, ref_id long, store_id int, target string, at long, slice int, delta string"
TARGET = "ref_table string, store_id int, target string, starts long, ends long, live int"


def brute_orphans(refs, targets):
    out = []
    for table, ref_id, store, key, at, *_ in refs:
        if key is None:
            continue
        there = any(t == table and s == store and store is not None and k == key and a is not None and at is not None and a <= at and (b is None or b > at) for t, s, k, a, b, *_ in targets)
        if not there:
            out.append((table, ref_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_orphans(spark, batches):
    rnd = random.Random(batches)
    day = orphans.DAY
    some = lambda *x: rnd.choice(x)
    targets = []
    for _ in range(60):
        a = rnd.randrange(0, 6 * day, day // 4)
        targets.append((some("a", "b"), some(1, 2, None), some("k1", "k2", "hot", None), some(a, a, None), some(None, a, a + day, a - day, a + 2 * day), 7))
    targets += targets[:5]
    refs = [(some("a", "b"), i, some(1, 1, 2, None), some("hot", "hot", "k1", "k2", "k3", None), some(None, *[rnd.randrange(0, 7 * day, day // 4) for _ in range(9)]), 3, "x") for i in range(300)]
    refs += refs[:4]
    found = orphans.replay(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), batches)
    assert sorted(((r.ref_table, r.ref_id) for r in found.orphans.collect()), key=str) == brute_orphans(refs, targets)
    daily = {(r.ref_table, str(r.day)): r.open_at_end for r in orphans.daily(found).collect()}
    for (table, day_text), n in daily.items():
        end = (datetime.fromisoformat(day_text) - datetime(1970, 1, 1)).days * day + day
        open_ = 0
        for t, _, s, k, at, *_ in refs:
            if t == table and s is not None and k is not None and at is not None and at < end:
                live = sum(1 for tt, ss, kk, a, b, *_ in targets if (tt, ss, kk) == (t, s, k) and a is not None and (b is None or b > a) and a < end and (b is None or b >= end))
                open_ += live == 0
        assert n == open_, (table, day_text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orphans_in_any_order(spark, seed):
    """Any split and any order of references, arrivals and removals gives the same orphans; changes add up to them."""
    rnd = random.Random(seed)
    targets = [("t", 1, rnd.choice("xyz"), a := rnd.randrange(100), rnd.choice([None, a + rnd.randrange(1, 40)]), 0) for _ in range(12)]
    refs = [("t", i, 1, rnd.choice("xyzw"), rnd.randrange(120), 0, "") for i in range(60)] + [("t", 99, None, "x", 5, 0, ""), ("t", 98, 1, "x", None, 0, "")]
    want = brute_orphans(refs, targets)
    events = [tuple(r) for r in orphans.target_events(spark.createDataFrame(targets, TARGET)).collect()]
    rows = [("r", r) for r in refs] + [("e", e) for e in events]
    rnd.shuffle(rows)
    cuts = sorted(rnd.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    batches = [(spark.createDataFrame([r for k, r in part if k == "r"], REF), spark.createDataFrame([r for k, r in part if k == "e"], "ref_table string, store_id int, target string, at long, delta int")) for part in parts]
    done = orphans.fold_all(batches, 7)
    assert sorted(((r.ref_table, r.ref_id) for r in done.orphans.collect()), key=str) == want
    net = {}
    for r in done.changes.collect():
        net[r.ref_table, r.ref_id] = net.get((r.ref_table, r.ref_id), 0) + r.change
    assert sorted((k for k, n in net.items() if n), key=str) == want and set(net.values()) <= {0, 1}
    whole = orphans.replay(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET))
    assert orphans.daily(done).select("ref_table", "day", "open_at_end").collect() == orphans.daily(whole).select("ref_table", "day", "open_at_end").collect()


def test_rows_below_the_floor_are_late(spark):
    event = "ref_table string, store_id int, target string, at long, delta int"
    ref = lambda *rows: spark.createDataFrame([("t", i, 1, k, at, 0, "") for i, k, at in rows], REF)
    batches = [(ref((1, "x", 15), (2, "y", 80)), spark.createDataFrame([], event)), (ref((3, "x", 3)), spark.createDataFrame([("t", 1, "x", 10, 1), ("t", 1, "y", 70, 1)], event))]
    done = orphans.fold_all(batches, 10, [5, 5])
    assert sorted(r.ref_id for r in done.orphans.collect()) == [1] and {r.ref_table: r.late for r in done.late.collect()} == {"t": 2}


def test_slices_divide_a_day():
    day = orphans.DAY
    for length, rows in ((0, 0), (133 * day, 4_000_000), (133 * day, 42_000_000), (10 * day, 10**9), (day, 10**12), (9999 * day, 1)):
        width = orphans.slice_width(length, rows)
        assert 1 <= width <= day and day % width == 0 and width <= max(1, length // max(orphans.LEAST_SLICES, rows // orphans.ROWS_PER_SLICE))


def test_orphans_empty(spark):
    none = spark.createDataFrame([], REF), spark.createDataFrame([], TARGET)
    done = orphans.replay(*none)
    assert done.orphans.count() == 0 and orphans.daily(done).count() == 0
    assert orphans.replay(spark.createDataFrame([("a", 1, 1, "k", 5, 0, "")], REF), none[1]).orphans.count() == 1


LOG = "delivery_id long, store_id int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long, txn_id long, rec_type byte, space long, bucket string, n int"


def brute_state(rows):
    by = {}
    for r in sorted({(r[1], r[2], r[3], r[4], r[5]) for r in rows if r[1] is not None and r[2] is not None and r[4] is not None}, key=lambda x: (x[0], x[1], x[2])):
        store, seq, op, key, value = r
        live = by.setdefault(store, {})
        if op == 0 and key[:1] != b"\x01":
            live[key] = seq
        elif op == 1:
            live.pop(key, None)
        elif op == 3 and value is not None:
            for k in [k for k in live if key <= k <= value]:
                del live[k]
    return sorted((s, q) for s, live in by.items() for q in live.values())


@pytest.mark.parametrize("size,stretch", [(40, 3), (400, 1 << 16)])
def test_changes(spark, size, stretch, monkeypatch):
    monkeypatch.setattr("siltbed.operators.cover.ROWS_PER_BUCKET", 10)
    monkeypatch.setattr("siltbed.operators.changes.STRETCH", stretch)
    rnd = random.Random(size)
    rows = []
    for i in range(size):
        op = rnd.choice([0, 0, 0, 1, 2, 3])
        key = rnd.choice([b"", b"hot", b"\x00", b"a", b"a\x00", b"b", b"\xff", b"\xff\xff", b"\x01s", b"zz", None])
        end = rnd.choice([b"a", b"hot", b"\xff\xff", b"", None]) if op == 3 else rnd.choice([None, b"", b"v"])
        rows.append((i, rnd.choice([1, 1, 2, None]), rnd.choice([i, i, i, None]), op, key, end, None, None, 0, 1, "x", 2))
    rows += rnd.sample(rows, size // 4)
    rnd.shuffle(rows)
    got = changes.current_keys(spark.createDataFrame(rows, LOG))
    assert sorted((r.store_id, r.seq_id) for r in got.collect()) == brute_state(rows)


def test_changes_with_base(spark):
    base = spark.createDataFrame([(1, b"a", 5), (1, b"b", 6), (1, b"c", 7)], "store_id int, key binary, seq_id long")
    feed = [(1, b"a", 9, 1), (1, b"b", 8, 0), (1, b"b", 8, 0), (1, b"c", 3, 1), (1, b"d", 4, 0)]
    got = changes.current_images(spark.createDataFrame(feed, "store_id int, key binary, seq_id long, op_type byte"), ["store_id", "key"], base, stretch=2)
    assert sorted((bytes(r.key), r.seq_id, r.op_type) for r in got.collect()) == [(b"a", 9, 1), (b"b", 8, 0), (b"c", 7, 0), (b"d", 4, 0)]


def test_changes_empty(spark):
    assert changes.current_keys(spark.createDataFrame([], LOG)).count() == 0


RECORD = "store_id int, file_name string, entry_no int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long, layer string, size_bytes int"
ENTRY = "entry_id long, store_id int, layer int, base_file_name string, size_bytes long, removed_at timestamp, key string"


def small_store():
    records, entries = [], []
    for i in range(30):
        for j in range(4):
            records.append((1, f"f{i}", j, i * 3 + j, 0, bytes([j]), None, None, "x", 1))
        records.append((1, f"f{i}", 9, None, 0, b"n", None, None, "x", 1))
        entries.append((i, 1, 0, f"data/s1/f{i}", 100, None, "k"))
    entries += [(90, 1, 0, "f0", 100, None, "k"), (91, 1, 1, "../f1", 100, None, "k"), (92, 1, 0, "f99", 100, None, "k"), (93, 1, 0, None, None, None, "k"), (94, None, 0, "f2", 1, None, "k")]
    entries += [(95, 2, 0, "g", 1, datetime(2025, 1, 1), "k")]
    return records, entries


def listed_now(table):
    return {(r.store_id, r.layer) for r in table.partitions(table.snapshot()[1]).collect()}


def rows_of(df):
    return sorted((r.store_id, r.layer, bytes(r.key), r.seq_id) for r in df.collect())


def test_small_files(spark):
    records, entries = small_store()
    rec, man = spark.createDataFrame(records, RECORD), spark.createDataFrame(entries, ENTRY)
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"))
    before = rows_of(table.read(rec, man))
    assert table.compact(rec, man) == 1 and listed_now(table) == {(1, 0)}
    want = sorted({(r[0], 0, r[3]) for r in records if r[3] is not None} | {(1, 1, r[3]) for r in records if r[1] == "f1" and r[3] is not None})
    got = table.read(rec, man).select("store_id", "layer", "seq_id").distinct()
    assert sorted((r.store_id, r.layer, r.seq_id) for r in got.collect()) == want and rows_of(table.read(rec, man)) == before
    assert table.compact(rec, man) == 0 and table.snapshot()[0] == 1
    # A new listing of the partition makes readers go back to the files until it is rewritten.
    more = spark.createDataFrame([*entries, (99, 1, 0, "g1", 5, None, "k")], ENTRY)
    extra = spark.createDataFrame([*records, (1, "g1", 0, 777, 0, b"q", None, None, "x", 1)], RECORD)
    assert table.read(extra, more).where("seq_id = 777").count() == 1
    old_reader = table.read(rec, man)
    assert table.compact(extra, more) == 1 and table.read(extra, more).where("seq_id = 777").count() == 1
    # A reader that took its snapshot before the rewrite sees that snapshot.
    assert rows_of(old_reader) == before


def test_a_conflict_changes_nothing(spark):
    records, entries = small_store()
    rec, man = spark.createDataFrame(records, RECORD), spark.createDataFrame(entries, ENTRY)
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"))
    changed = spark.createDataFrame([*entries, (99, 1, 0, "late", 5, None, "k")], ENTRY)
    more = spark.createDataFrame([*records, (1, "late", 0, 777, 0, b"q", None, None, "x", 1)], RECORD)
    want, wide = rows_of(table.read(more, man)), rows_of(table.read(more, changed))
    with pytest.raises(smallfiles.Conflict):
        table.compact(more, man, relist=lambda: changed)
    assert table.snapshot() == (0, None) and rows_of(table.read(more, man)) == want and rows_of(table.read(more, changed)) == wide
    # The same with a snapshot in place: a run that saw one file more gives up; readers of both listings get theirs.
    assert table.compact(more, man) == 1
    with pytest.raises(smallfiles.Conflict):
        table.compact(more, changed, relist=lambda: man)
    assert rows_of(table.read(more, man)) == want and rows_of(table.read(more, changed)) == wide
    table.lease_ms, table.now_ms = 0, lambda: 1 << 60
    assert len(table.vacuum()) == 2 and rows_of(table.read(more, man)) == want


def test_claims_expire(spark):
    records, entries = small_store()
    rec, man = spark.createDataFrame(records, RECORD), spark.createDataFrame(entries, ENTRY)
    now = [1000]
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"), now_ms=lambda: now[0], lease_ms=500)
    table._claim(1)
    with pytest.raises(smallfiles.Conflict):
        table.compact(rec, man)
    now[0] = 1501
    assert table.compact(rec, man) == 1 and table.snapshot()[0] == 1
    # A snapshot that another run published in between, or left unfinished, is not overwritten.
    table._create("_snapshots", "2", {"map": table.snapshot()[1], "base": 1})
    with pytest.raises(smallfiles.Conflict):
        table._create("_snapshots", "2", {})
    jvm, fs, folder = table._fs("_snapshots")
    fs.create(jvm.org.apache.hadoop.fs.Path(folder, "3"), False).close()
    assert table.snapshot()[0] == 2 and rows_of(table.read(rec, man)) == rows_of(smallfiles.CompactedTable(spark, scratch(spark, "u")).read(rec, man))


def test_wrong_sizes_in_the_manifest(spark):
    """The number of files follows from the records, whatever the manifest says of sizes."""
    records = [(1, f"f{i % 10}", i, i, 0, b"key%05d" % i, b"v" * 1000, None, "x", 1) for i in range(400)]
    entries = [(i, 1, 0, f"f{i}", None if i % 2 else 0, None, "k") for i in range(10)]
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"))
    rec, man = spark.createDataFrame(records, RECORD), spark.createDataFrame(entries, ENTRY)
    assert table.compact(rec, man, file_bytes=50_000) == 1
    version = table.partitions(table.snapshot()[1]).first().version
    files = spark.read.parquet(f"{table.path}/data").where(f"version = '{version}'").select(F.input_file_name().alias("f"), "seq_id").groupBy("f").count().collect()
    assert 6 <= len(files) <= 12 and sum(r["count"] for r in files) == 400


def test_sizing_exchanges_no_records(spark, monkeypatch):
    """A long listing is joined by merging: whole records are then exchanged twice, by file and by key range, and not for their sizes."""
    rnd = random.Random(4)
    records = [(1 + i % 2, f"f{i % 40}", i, i // 3 if i % 5 == 0 else i, 0, b"key%05d" % i, rnd.randbytes(2000), None, "x", 1) for i in range(2000)]
    records += [*records[:40], (1, "f0", 9, None, 0, b"n", None, None, "x", 1), (1, "f0", 9, 5000, 0, None, None, None, "x", 1), (1, "gone", 1, 1, 0, b"g", None, None, "x", 1)]
    entries = [(i, 1 + i % 2, 0, f"data/f{i}", 100, None, "k") for i in range(40)] + [(90, 1, 3, "f0", 100, None, "k")]
    rec, man = spark.createDataFrame(records, RECORD), spark.createDataFrame(entries, ENTRY)
    folder = scratch(spark, "r")
    rec.write.parquet(folder)
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"))
    kept = [r for r in records if r[3] is not None and r[1] != "gone"]
    total = sum(24 + len(r[5] or b"") + len(r[6] or b"") for r in [*kept, *(r for r in kept if r[1] == "f0")])
    assert smallfiles.listed_bytes(rec, smallfiles.listing(man)).first()["bytes"] == total
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(status.executorList(False).apply(i).totalShuffleWrite() for i in range(status.executorList(False).size()))
    monkeypatch.setattr(smallfiles, "BROADCAST_NAMES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert table.compact(spark.read.schema(RECORD).parquet(folder), man) == 2
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved < 2.5 * 2000 * 2040
    data = spark.read.parquet(f"{table.path}/data")
    got = sorted((r.store_id, r.layer, r.seq_id, bytes(r.key or b""), bytes(r.value or b"")) for r in data.collect())
    assert got == sorted({(r[0], 0, r[3], r[5] or b"", r[6] or b"") for r in kept})
    assert data.inputFiles() and all(f.endswith(".zstd.parquet") for f in data.inputFiles())


def test_small_files_empty(spark):
    table = smallfiles.CompactedTable(spark, scratch(spark, "t"))
    rec, man = spark.createDataFrame([], RECORD), spark.createDataFrame([], ENTRY)
    assert table.compact(rec, man) == 0 and table.read(rec, man).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "kind string, store_id int, item_id long, version long, leaf string")


def test_new_only(spark):
    first = [("record", 1, i, i, "") for i in range(0, 20_000, 7)] + [("file", 2, 5, 1, ""), ("file", None, 5, 1, ""), ("file", 2, None, 1, "")]
    tracker = newonly.Tracker(spark, scratch(spark, "n"))
    assert tracker.run(items(spark, first + first[:3])).count() == len(first) - 2
    second = [r for r in first if r[2] != 700] + [("record", 1, 3, 1, ""), ("file", 2, 5, 2, ""), ("record", 3, 90_000, 1, "")]
    got = {tuple(r) for r in tracker.run(items(spark, second)).collect()}
    assert got == {("record", 1, 3, 1), ("file", 2, 5, 2), ("record", 3, 90_000, 1)}
    assert tracker.run(items(spark, second)).count() == 0 and tracker.version() == 3


def test_new_only_survives_a_failure(spark, monkeypatch):
    tracker = newonly.Tracker(spark, scratch(spark, "n"))
    tracker.run(items(spark, [("record", 1, 1, 1, "")]))
    more = items(spark, [("record", 1, 1, 1, ""), ("record", 1, 2, 1, "")])
    publish = newonly.Tracker._publish

    def die(self, version):
        raise RuntimeError("lost")

    monkeypatch.setattr(newonly.Tracker, "_publish", die)
    with pytest.raises(RuntimeError):
        tracker.run(more)
    monkeypatch.setattr(newonly.Tracker, "_publish", publish)
    assert tracker.version() == 1 and [r.item_id for r in tracker.run(more).collect()] == [2]


def test_flushed(spark):
    rnd = random.Random(3)
    at = lambda k: datetime.fromtimestamp(1_700_000_000 + k)
    log = [(rnd.choice([1, 2, None]), rnd.choice([rnd.randrange(9000), None]), rnd.choice([at(rnd.randrange(99)), None]), rnd.choice([0, 2, 1])) for _ in range(400)]
    runs = [(rnd.choice([1, 2, None]), rnd.choice(["ok", " OK", "failed", None]), rnd.choice([rnd.randrange(9000), None]), rnd.choice([at(rnd.randrange(99)), None])) for _ in range(40)]
    found = newonly.log_items(spark.createDataFrame(log, "store_id int, seq_id long, arrived_at timestamp, rec_type int"))
    done = newonly.flushed(found, spark.createDataFrame(runs, "store_id int, status string, flushed_up_to_seq_id long, started_at timestamp"))
    want = set()
    for store, seq in {(r[0], r[1]) for r in log if r[0] and r[1] is not None and r[3] in (0, 2)}:
        first = min((r[2] for r in log if r[:2] == (store, seq) and r[3] in (0, 2) and r[2]), default=None)
        if first and any(s == store and st and st.strip().lower() == "ok" and m is not None and m >= seq and t and t >= first for s, st, m, t in runs):
            want.add((store, seq))
    assert {(r.store_id, r.item_id) for r in done.collect()} == want


def test_backed_up(spark):
    when = datetime(2025, 1, 2)
    files = spark.createDataFrame([(1, "data", i, n, when, None) for i, n in enumerate(["a", "b", None, "c"])], "store_id int, dir string, file_id long, file_name string, modified_at timestamp_ntz, deleted_at timestamp")
    backups = [(1, "Complete ", 1735776000, ["x/a", None]), (1, "complete", 1735775999, ["b"]), (1, "failed", 1835776000, ["c"]), (1, "complete", None, ["c"]), (1, "complete", 1835776000, None)]
    done = newonly.backed_up(newonly.file_items(files), spark.createDataFrame(backups, "store_id int, status string, ts long, new_files array<string>"))
    assert [r.item_id for r in done.collect()] == [0]
    assert done.where(F.col("item_id") > 9).count() == 0
