"""Micro-logs, and the log operators against a small model in plain Python."""

import hashlib
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.functions.hashing import halves, seed
from siltbed.functions.ttl import parse_ttl
from siltbed.operators import backups, bucket, changes, compaction, cover, folds, history, log, merkle, notify, ordered, resolve, scan, sketches
from siltbed.sources.store import effective, references, targets

LOG = "store_id int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long, txn_id long, rec_type byte"


def frame(spark, rows):
    """rows: (seq_id, op_type, key, value[, expires, txn, rec_type])."""
    full = [(1, r[0], r[1], r[2].encode() if isinstance(r[2], str) else r[2], r[3].encode() if isinstance(r[3], str) else r[3], *(list(r[4:]) + [None, None, 0][len(r) - 4 :])) for r in rows]
    return spark.createDataFrame(full, LOG)


def state(spark, rows, **how):
    return {bytes(r.key).decode("latin1"): bytes(r.value or b"").decode("latin1") for r in resolve.state(effective(frame(spark, rows)), **how).collect()}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, 0, "key1", "value1")], {"key1": "value1"}),
        ([(1, 0, "key1", "v1"), (2, 0, "key1", "v2")], {"key1": "v2"}),
        ([(1, 0, "key1", "v1"), (2, 1, "key1", None)], {}),
        ([(10, 1, "k", None), (20, 0, "k", "v")], {"k": "v"}),
        ([(20, 0, "k", "v"), (10, 1, "k", None)], {"k": "v"}),
        ([(1, 0, "a", "1"), (2, 0, "b", "2"), (3, 3, "a", "a")], {"b": "2"}),
        ([(1, 0, "a", "1"), (2, 3, "a", "c"), (3, 0, "b", "2"), (4, 0, "c\x00", "3")], {"b": "2", "c\x00": "3"}),
        ([(1, 0, "a", "1"), (2, 3, "z", "a")], {"a": "1"}),
        ([(1, 0, "a", ""), (2, 0, b"\x01\x01x", "s")], {"a": ""}),
        ([(1, 0, "a", "1", None, 7, 2), (2, 0, "b", "2", None, 8, 2), (2, 0, b"", None, None, 8, 3)], {"b": "2"}),
        ([], {}),
    ],
)
def test_micro_logs(spark, rows, want):
    assert state(spark, rows) == want
    assert state(spark, rows + rows) == want


def test_expiry_is_judged_last(spark):
    rows = [(1, 0, "a", "old"), (2, 0, "a", "new", 100), (3, 0, "b", "x", 101), (4, 0, "c", "y", 0)]
    assert state(spark, rows, now_ms=100) == {"b": "x", "c": "y"} and state(spark, rows, now_ms=99)["a"] == "new"
    assert state(spark, rows, now_ms=100, as_of=1) == {"a": "old"}


RECORD = st.tuples(st.sampled_from([0, 0, 0, 1, 3]), st.sampled_from([b"", b"a", b"a\x00", b"b", b"c", b"\xff"]), st.sampled_from([b"", b"a", b"b", b"\xff"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(RECORD, max_size=25), st.integers(0, 25), st.randoms())
def test_any_log_gives_the_models_state(spark, ops, as_of, rnd):
    model = {}
    for seq, (op, key, value) in enumerate(ops[:as_of], 1):
        if op == 0:
            model[key] = value
        elif op == 1:
            model.pop(key, None)
        else:
            for k in [k for k in model if key <= k <= value]:
                del model[k]
    rows = [(seq, *r) for seq, r in enumerate(ops, 1)]
    rnd.shuffle(rows)
    got = {bytes(r.key): bytes(r.value) for r in resolve.state(effective(frame(spark, rows + rows[:3])), as_of=as_of).collect()}
    assert got == model


@pytest.mark.parametrize("few", [0, 1000])
def test_cover_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "FEW_RANGES", few)
    monkeypatch.setattr(cover, "ROWS_PER_BUCKET", 7)
    rnd = random.Random(few)
    keys = [bytes(rnd.choices(b"ab\x00\xff", k=rnd.randrange(4))) for _ in range(150)]
    points = sorted({(s, k): (s, k, rnd.randrange(100)) for k in keys for s in (1, 2)}.values())
    ranges = [(rnd.choice([1, 2]), *sorted(rnd.choices(keys, k=2)), rnd.randrange(100)) for _ in range(60)]
    got = resolve.with_cover(spark.createDataFrame(points, "store_id int, key binary, seq_id long"), spark.createDataFrame(ranges, "store_id int, start_key binary, end_key binary, seq_id long")).collect()
    want = {(s, k): max((q for t, a, b, q in ranges if t == s and a <= k <= b and q > seq), default=None) for s, k, seq in points}
    assert {(r.store_id, bytes(r.key)): r.cover_seq for r in got} == want


def test_fragments(spark):
    rows = spark.createDataFrame([(1, b"a", b"z", 10), (1, b"c", b"d", 4), (1, b"b", b"b", 20), (2, b"x", b"x", 1)], "store_id int, start_key binary, end_key binary, seq_id long")
    got = sorted((r.store_id, bytes(r.start_key), bytes(r.past_key), r.seq_id) for r in resolve.fragments(rows).collect())
    assert got == [(1, b"a", b"b", 10), (1, b"b", b"b\x00", 20), (1, b"b\x00", b"c", 10), (1, b"c", b"d\x00", 10), (1, b"d\x00", b"z\x00", 10), (2, b"x", b"x\x00", 1)]
    assert resolve.fragments(rows.limit(0)).count() == 0


def test_numbering_and_carrying(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    numbered = {(r.g, r.o): r.n for r in ordered.numbered(df, ["g"], [F.col("o").desc()]).collect()}
    carried = {(r.g, r.o): r.last for r in ordered.last_before(df, ["g"], ["o"], F.col("v"), "last").collect()}
    for g in ("hot", "b", None):
        mine = sorted((o, v) for h, o, v in rows if h == g)
        last = None
        for i, (o, v) in enumerate(mine):
            last = v if v is not None else last
            assert numbered[g, o] == len(mine) - 1 - i and carried[g, o] == last
    assert len(numbered) == len(rows) and ordered.numbered(df.limit(0), ["g"], [F.col("o")]).count() == 0


def test_scans(spark):
    rows = resolve.state(frame(spark, [(i, 0, k, "v") for i, k in enumerate(["user:1", "user:2", "order:1", "user", "user;"], 1)]))
    assert scan.prefix_scan(rows, b"user:").count() == 2 and scan.range_scan(rows, b"", b"order:1").count() == 1 and scan.range_scan(rows, b"user", b"").count() == 4
    assert [bytes(r.key) for r in scan.page(rows, 1, 2).collect()] == [b"user:1", b"user:2"] and scan.page(rows, -4, 2).count() == 2 and scan.page(rows, 9, 2).count() == 0
    assert [bytes(r.key) for r in scan.iterate(rows)][0] == b"order:1"
    pages = {r.page: (r.rows, bytes(r.first_key)) for r in scan.page_directory(rows, 2).collect()}
    assert pages == {0: (2, b"order:1"), 1: (2, b"user:1"), 2: (1, b"user;")}
    with pytest.raises(ValueError):
        scan.page_directory(rows, 0)


def test_history(spark):
    df = frame(spark, [(1, 0, "k", "a"), (2, 1, "k", None), (3, 0, "k", "ccc"), (3, 0, "k", "ccc"), (4, 0, "j", None)])
    assert sorted((bytes(r.key), r.version, r.seq_id) for r in history.history(df).collect()) == [(b"j", 0, 4), (b"k", 0, 3), (b"k", 1, 1)]
    assert history.newest_versions(df, 1).count() == 2
    assert {(r.seq_id, r.old_seq) for r in history.differences(df).collect()} == {(4, None), (3, 1), (1, None)}
    snaps = spark.createDataFrame([(1, b"k", 2), (1, b"none", 1)], "store_id int, key binary, since_seq long")
    assert sorted(r.seq_id for r in history.kept_by_snapshots(df, snaps).collect()) == [2, 3]


def test_transactions(spark):
    df = frame(spark, [(1, 0, "a", "1"), (2, 0, b"", None, None, 1, 1), (2, 0, "b", "2", None, 1, 2), (3, 0, "c", "3", None, 1, 2), (3, 0, b"", None, None, 1, 3), (4, 0, "d", "4", None, 2, 2), (5, 1, "a", None, None, 3, 2), (5, 0, b"", None, None, 3, 3)])
    assert {(r.txn_id, r.records, r.committed) for r in log.transactions(df).collect()} == {(1, 2, True), (2, 1, False), (3, 1, True)}
    assert [r.txn_id for r in log.batches(df, 0).collect()] == [1] and [r.txn_id for r in log.batches(df, 1).collect()] == [3]
    marks = spark.createDataFrame([(1, 2, None), (1, 99, "2025-01-01")], "store_id int, flushed_up_to_seq_id long, deleted_at string")
    assert sorted(r.seq_id for r in log.replay(df, marks).collect()) == [3, 5]


def test_batches_are_whole_files(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert log.append_batch(spark, path, [(b"a", b"1"), (b"b", b"2")], 0, 1, 5, 9) == 7
    with pytest.raises(ValueError):
        log.append_batch(spark, path, [(b"c", b"1"), (b"", b"2")], 0, 1, 7, 10)
    assert sorted(r.seq_id for r in effective(spark.read.parquet(path)).collect()) == [5, 6]


def md5_number(value: bytes, i: int = 0) -> int:
    return int.from_bytes(hashlib.md5(value + seed(i)).digest()[:8], "big")


def test_hash_and_sizes(spark):
    high, low = halves(F.col("k"), seed(0))
    row = spark.createDataFrame([(b"abc",)], "k binary").select(high.alias("h"), low.alias("l")).first()
    assert row.h << 32 | row.l == md5_number(b"abc")
    assert sketches.bloom_size(1000, 0.01) == (9586, 7) and sketches.bloom_size(0, 7) == sketches.bloom_size(1, 0.01) and sketches.cms_size(0.01, 0.99) == (272, 5)


def test_sketches(spark):
    rows = [(b"user-%d" % i, i % 50) for i in range(2000)] + [(b"same", 1)] * 300 + [(None, 1)]
    df = spark.createDataFrame(rows, "k binary, n int")
    bits = sketches.bloom_bits(df, [], "k", *sketches.bloom_size(3000, 0.01))
    asked = spark.createDataFrame([(b"user-%d" % i,) for i in range(0, 3000, 10)], "k binary")
    found = {bytes(r.k): r.contained for r in sketches.bloom_contains(asked, [], "k", bits, *sketches.bloom_size(3000, 0.01)).collect()}
    assert all(found[b"user-%d" % i] for i in range(0, 2000, 10)) and sum(found.values()) < 215
    cells = sketches.cms_table(df, [], "k", 272, 5)
    estimate = {bytes(r.k): r.estimate for r in sketches.cms_estimate(df, [], "k", cells, 272, 5).collect()}
    assert estimate[b"same"] >= 300 and all(n >= 1 for n in estimate.values()) and cells.agg(F.sum("n")).first()[0] == 5 * 2300
    registers = sketches.hll_registers(df, [], "k", 14)
    assert abs(sketches.hll_count(registers, [], 14).first()[0] - 2001) < 60
    want = {}
    for k, _ in rows[:-1]:
        h = md5_number(k)
        rest = h & ((1 << 50) - 1)
        want[h >> 50] = max(want.get(h >> 50, 0), 50 - rest.bit_length() + 1)
    assert {r.idx: r["rank"] for r in registers.collect()} == want
    assert sketches.hll_count(registers.limit(0), [], 14).count() == 1


def test_simhash(spark):
    docs = [(1, "Hello, WORLD!! 123"), (2, "hello world 123"), (3, ""), (4, None), (5, "--"), (6, "Go, go! gO 123 123 x-y")]
    got = {r.id: (r.hi, r.lo) for r in sketches.simhash(spark.createDataFrame(docs, "id int, t string"), "id", "t").collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] == (0, 0)
    sums = [0] * 64
    for token in ["go", "go", "go", "123", "123", "x", "y"]:
        h = md5_number(token.encode())
        sums = [s + (1 if h >> b & 1 else -1) for b, s in enumerate(sums)]
    want = sum(1 << b for b, s in enumerate(sums) if s >= 0)
    assert got[6] == (want >> 32, want & 0xFFFFFFFF)


def test_near_fingerprints_is_exact(spark):
    rnd = random.Random(4)
    prints = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        prints += [x] + [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(3)]
    rows = [(p >> 32, p & 0xFFFFFFFF) for p in prints]
    got = {(r.a_hi << 32 | r.a_lo, r.b_hi << 32 | r.b_lo): r.distance for r in sketches.near_fingerprints(spark.createDataFrame(rows + rows[:9], "hi long, lo long")).collect()}
    distinct = sorted(set(prints))
    assert got == {(a, b): (a ^ b).bit_count() for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_near_fingerprints_are_not_broadcast(spark):
    """Twenty rows of a print are joined, which size estimates miss; each pair comes once, whatever blocks it agrees in."""
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    prints = sorted({*prints, *(p ^ sum(1 << b for b in rnd.sample(range(64), n)) for p in prints[:60] for n in (1, 2, 3, 4))})
    df = spark.createDataFrame([(p >> 32, p & 0xFFFFFFFF) for p in prints], "hi long, lo long")
    for most, spare in ((3, 3), (0, 1), (1, 2)):
        near = sketches.near_fingerprints(df, most, spare)
        got = sorted((r.a_hi << 32 | r.a_lo, r.b_hi << 32 | r.b_lo, r.distance) for r in near.collect())
        assert got == [(a, b, (a ^ b).bit_count()) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= most]
        assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_folds_by_kind(spark):
    """Payloads of any length, repeated records, a second base, a delete, operands without a base, an unknown kind."""
    item = lambda i: b"item %d " % i * 40
    rows, seq = [], 0
    for kind in (1, 2, 3):
        rows += [(seq + 1, 2, b"\x01%cn" % kind, b"\x00"), (seq + 2, 2, b"\x01%cn" % kind, b"\xffforgotten"), (seq + 3, 2, b"\x01%cn" % kind, b"\x00")]
        rows += [(seq + 4 + i, 2, b"\x01%cn" % kind, b"\xff" + item(i % 30)) for i in range(60)]
        seq += 100
    rows += [(500, 2, b"\x01\x04s", b"\x00" + b"old"), (501, 2, b"\x01\x04s", b"\x00" + b"new"), (502, 2, b"\x01\x01lost", b"\xffx"), (503, 2, b"\x01\x01lost", b"\x00"), (504, 2, b"\x01\x09u", b"\x00")]
    rows += [(505, 2, b"\x01\x02gone", b"\x00"), (506, 1, b"\x01\x02gone", None), (507, 2, b"\x01\x01", b""), (508, 2, "user", b"\xffx"), (509, 2, b"\x01\x03e", b"\x00")]
    df = frame(spark, rows + rows[:9])
    got = {bytes(r.key): r for r in folds.fold(df).collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {b"\x01\x01lost": "operand before base", b"\x01\x09u": "no fold for this kind"}
    assert set(got) == {b"\x01\x01n", b"\x01\x02n", b"\x01\x03n", b"\x01\x04s", b"\x01\x01lost", b"\x01\x09u", b"\x01\x03e"} and bytes(got[b"\x01\x04s"].newest) == b"new"
    assert got[b"\x01\x02n"].operands == 60 and got[b"\x01\x02n"].base_seq == 103 and got[b"\x01\x03e"].cells == []
    out = {bytes(r.key): bytes(r.value)[1:] for r in folds.compacted(df, True).where("op_type = 2 and seq_id not in (502, 503, 504)").collect()}
    assert all(folds.contains(out[b"\x01\x01n"], item(i)) for i in range(30)) and not folds.contains(out[b"\x01\x01n"], b"forgotten")
    assert [folds.frequency(out[b"\x01\x02n"], item(i)) >= 2 for i in range(30)] == [True] * 30 and abs(folds.distinct(out[b"\x01\x03n"]) - 30) <= 1 and folds.distinct(out[b"\x01\x03e"]) == 0
    # Folding what was folded, with more operands, is folding all at once.
    half = folds.compacted(frame(spark, rows[:160]), False).withColumn("expires_at_ms", F.lit(None).cast("long")).withColumn("txn_id", F.lit(None).cast("long")).withColumn("rec_type", F.lit(0).cast("byte"))
    again = {bytes(r.key): (r.cells, r.a) for r in folds.fold(half.unionByName(frame(spark, rows[160:]))).collect() if not r.error}
    assert again == {k: (r.cells, r.a) for k, r in got.items() if not r.error}
    assert {(bytes(r.key), r.seq_id) for r in folds.compacted(df, True).where("op_type = 1").collect()} == {(b"\x01\x02gone", 506)}
    assert folds.fold(df.limit(0)).count() == 0 and folds.compacted(df.limit(0), True).count() == 0


def test_states_of_sketches():
    for kind, a, b in ((1, 100, 3), (2, 10, 4), (3, 6, 0)):
        x, y = folds.encode(kind, a, b, [1, 5], [1, 1]), folds.encode(kind, a, b, [5, 7], [1, 1])
        both = folds.decode(folds.merge(x, y))[3]
        assert [int(v) for v in both[[1, 5, 7]]] == [1, 2 if kind == 2 else 1, 1] and int(both.sum()) == (4 if kind == 2 else 3)
        assert folds.clear(x) == folds.empty(kind, a, b) and not folds.decode(folds.clear(x))[3].any()
        with pytest.raises(ValueError):
            folds.merge(x, folds.empty(kind, a + 1, b))
        assert folds.decode(x[:-1]) is None and folds.decode(b"") is None and folds.decode(b"Z" + x[1:]) is None
    with pytest.raises(ValueError):
        folds.clear(b"none")
    with pytest.raises(ValueError):
        folds.register(1, folds.REGISTRY[1])


def merkle_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in zip(hashes[::2], hashes[1::2] + (hashes[-1:] if len(hashes) % 2 else []))]
    return hashes[0]


@pytest.mark.parametrize("n,bits", [(1, 10), (7, 10), (2, 1), (3, 1), (8, 2), (13, 2)])
def test_merkle(spark, n, bits, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = [(1, "f", i, i, 0, b"k%d" % i, None if i % 2 else b"v") for i in range(n)]
    df = spark.createDataFrame(rows, "store_id int, file_name string, entry_no int, seq_id long, op_type byte, key binary, value binary")
    leaf = merkle.leaves(df)
    hashes = [hashlib.sha256(f"{i}|0|{(b'k%d' % i).hex().upper()}|{'-' if i % 2 else '76'}".encode()).hexdigest() for i in range(n)]
    assert merkle.roots(leaf).first().root == merkle_root(hashes)
    for at in {0, n // 2, n - 1}:
        h, where = hashes[at], at
        for r in sorted(merkle.proof(leaf, at).collect(), key=lambda r: r.level):
            pair = (r.sibling, h) if where % 2 else (h, r.sibling)
            h, where = hashlib.sha256(bytes.fromhex(pair[0]) + bytes.fromhex(pair[1])).hexdigest(), where // 2
        assert h == merkle_root(hashes)
    proven = merkle.proofs(leaf)
    assert [(r.leaves, r.proven) for r in merkle.verified(proven, merkle.roots(leaf)).collect()] == [(n, n)] and merkle.roots(leaf).first().height == (n - 1).bit_length()
    assert n == 1 or merkle.verified(proven.withColumn("hash", F.sha2("hash", 256)), merkle.roots(leaf)).first().proven == 0
    hurt = merkle.leaves(df.withColumn("value", F.when(F.col("seq_id") == n - 1, F.lit(b"x")).otherwise(F.col("value"))))
    r = merkle.corrupted(leaf, hurt).first()
    assert (r.valid, r.bad_blocks, r.first_bad) == (False, 1, n - 1) and merkle.corrupted(leaf, leaf).first().valid


FILES = "store_id int, file_name string, entry_no int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long"
ENTRIES = "store_id int, layer int, base_file_name string, size_bytes long, removed_at timestamp, min_key binary, max_key binary"


def test_compaction_keeps_the_state(spark):
    rnd = random.Random(8)
    ops = [(1, f"f{i // 5}", i % 5, i, rnd.choice([0, 0, 1, 3]), rnd.choice([b"a", b"b", b"c", b"d"]), rnd.choice([b"b", b"d"]), None) for i in range(60)]
    records = spark.createDataFrame(ops, FILES)
    entries = [(1, 0 if i >= 8 else 1, f"x/f{i}", 10, None, b"a", b"d") for i in range(12)]
    manifest = spark.createDataFrame(entries, ENTRIES)
    want = {(bytes(r.key), r.seq_id) for r in resolve.state(records).collect()}
    assert {(bytes(r.key), r.seq_id) for r in compaction.merged(records, manifest).collect()} == want
    kept = compaction.merged(records, manifest, [1], drop_tombstones=False)
    assert kept.where("seq_id >= 40").count() == 0
    for layers in ([0], [1]):
        part = compaction.merged(records, manifest, layers, drop_tombstones=False)
        both = part.unionByName(compaction.rest(records, manifest, layers).select(*part.columns))
        assert {(bytes(r.key), r.seq_id) for r in resolve.state(both).collect()} == want
    plan = compaction.leveled_plan(manifest).first()
    assert (plan.inputs, plan.overlapping) == (4, 8) and compaction.size_tiered_plan(manifest).count() == 2
    assert compaction.merged(records.limit(0), manifest, drop_tombstones=False).count() == 0


def test_partial_compactions_bring_nothing_back(spark):
    """Range deletes, deletes and expiries of upper layers go on hiding what lies deeper; snapshots keep versions; dominated ranges go."""
    ops = [
        (1, "deep", 0, 1, 0, b"k", b"1", None), (1, "deep", 1, 2, 0, b"z9", b"2", None), (1, "deep", 2, 3, 0, b"old", b"3", None), (1, "deep", 3, 4, 0, b"dead", b"4", None),
        (1, "up", 0, 9, 3, b"a", b"m", None), (1, "up", 1, 8, 3, b"b", b"c", None), (1, "up", 2, 10, 0, b"old", b"5", 50), (1, "up", 3, 11, 1, b"dead", None, None), (1, "up", 4, 12, 0, b"z9", b"6", None), (1, "up", 5, 7, 0, b"z9", b"x", None),
    ]
    records, manifest = spark.createDataFrame(ops, FILES), spark.createDataFrame([(1, 0, "up", 1, None, b"a", b"z"), (1, 2, "deep", 1, None, b"a", b"z")], ENTRIES)
    part = compaction.merged(records, manifest, [0], drop_tombstones=False, now_ms=100)
    got = sorted((bytes(r.key), r.seq_id, r.op_type) for r in part.collect())
    assert got == [(b"a", 9, 3), (b"dead", 11, 1), (b"old", 10, 1), (b"z9", 12, 0)]
    both = part.unionByName(compaction.rest(records, manifest, [0]).select(*part.columns))
    assert [(bytes(r.key), r.seq_id) for r in resolve.state(both).collect()] == [(b"z9", 12)]
    snaps = spark.createDataFrame([(1, b"z9", 8)], "store_id int, key binary, since_seq long")
    whole = compaction.merged(records, manifest, now_ms=100, snapshots=snaps)
    assert sorted((bytes(r.key), r.seq_id) for r in whole.where("op_type != 3").collect()) == [(b"z9", 7), (b"z9", 12)]


def test_many_subscriptions_meet_in_buckets(spark, monkeypatch):
    rnd = random.Random(12)
    word = lambda: bytes(rnd.choices(b"ab\x00\xff", k=rnd.randrange(3)))
    subs = [(i, word(), word()) for i in range(120)] + [(900, None, b"x")]
    rows = [(i, rnd.choice([0, 1, 3]), word(), word()) for i in range(80)]
    df, listeners = frame(spark, rows), spark.createDataFrame(subs, "listener_id long, lower binary, upper binary")
    want = [sorted((r.listener_id, r.seq_id) for r in f(df, listeners).collect()) for f in (notify.point_events, notify.range_events)]
    over = lambda lo, hi, a, b: (not hi or lo <= hi) and (not lo or lo <= b) and (not hi or hi >= a)
    assert want[0] == sorted((i, q) for i, lo, hi in subs[:-1] for q, op, k, _ in rows if op < 2 and over(lo, hi, k, k))
    assert want[1] == sorted((i, q) for i, lo, hi in subs[:-1] for q, op, k, v in rows if op == 3 and k <= v and over(lo, hi, k, v))
    monkeypatch.setattr(notify, "FEW", 0)
    monkeypatch.setattr(cover, "ROWS_PER_BUCKET", 9)
    assert [sorted((r.listener_id, r.seq_id) for r in f(df, listeners).collect()) for f in (notify.point_events, notify.range_events)] == want


def test_notifications(spark):
    subs = spark.createDataFrame([(1, b"a", b"c"), (2, b"", b"b"), (3, b"m", b"")], "listener_id long, lower binary, upper binary")
    df = frame(spark, [(1, 0, "a", "1"), (2, 0, "c", "1"), (3, 1, "z", None), (4, 3, "b", "n"), (5, 3, "d", "e"), (6, 2, "a", "1")])
    assert sorted((r.listener_id, r.seq_id, r.type) for r in notify.point_events(df, subs).collect()) == [(1, 1, "PUT"), (1, 2, "PUT"), (2, 1, "PUT"), (3, 3, "DELETE")]
    assert sorted((r.listener_id, r.seq_id) for r in notify.range_events(df, subs).collect()) == [(1, 4), (2, 4), (3, 4)]
    assert notify.delivered(notify.point_events(df, subs), 1).count() == 3


def test_token_bucket(spark):
    rnd = random.Random(6)
    calls = [(rnd.choice(["hot", "hot", "b", None]), i, rnd.choice([rnd.randrange(900), None, 5])) for i in range(300)]
    got = {r.call_id: r.admitted for r in bucket.admissions(spark.createDataFrame(calls, "bucket string, call_id long, at_ms long"), 3, 100).collect()}
    want = {}
    for name in ("hot", "b"):
        tokens, last = 0, None
        for at, i in sorted((at, i) for b, i, at in calls if b == name and at is not None):
            if last is None or at - last >= 100:
                tokens, last = 3, at
            want[i] = tokens > 0
            tokens -= tokens > 0
    assert got == want


def test_backups(spark):
    rows = [
        (1, 1, "1", None, 10, ["x/f0"], "2025-01-01", "a"), (2, 1, "2", " 1", 20, ["f0", "y/f1"], "2025-01-02", "a"), (3, 1, "3", "2", 30, ["f2", None], "2025-01-03", "a"),
        (4, 1, "3", "2", 30, ["f2"], "2025-01-02", "a"), (5, 1, "4", "lost", 40, ["f0"], "2025-01-04", "a"), (6, 2, "1", "", 10, None, "2025-01-01", "a"), (7, 1, "c", "c", 5, ["z"], "2025-01-01", "a"),
    ]
    df = backups.distinct_backups(spark.createDataFrame(rows, "backup_no long, store_id int, id string, base_id string, ts long, files array<string>, recorded_at string, file string"))
    assert {(r.id, r.file) for r in backups.incremental_files(df).where("store_id = 1").collect()} == {("1", "f0"), ("2", "f1"), ("3", "f2"), ("4", "f0"), ("c", "z")}
    assert {(r.file, r.from_id) for r in backups.restore_set(df).where("id = '3' and store_id = 1").collect()} == {("f0", "2"), ("f1", "2"), ("f2", "3")}
    assert {(r.id, r.dependent) for r in backups.cascade(df).collect()} == {("1", "2"), ("1", "3"), ("2", "3")}


def test_ttl_literals(spark):
    rows = [("5",), ("5s",), ("5ms",), ("2min",), ("1h",), ("1D",), ("1M",), ("1Y",), ("x",), ("5d",), ("",), (None,), ("-1s",)]
    got = [r.t for r in spark.createDataFrame(rows, "l string").select(parse_ttl(F.col("l")).alias("t")).collect()]
    assert got == [5000, 5000, 5, 120_000, 3_600_000, 86_400_000, 2_592_000_000, 31_536_000_000, None, None, None, None, None]


def test_long_ttl_literals(spark):
    rows = [("1744675200000ms",), ("9223372036854775807ms",), ("9223372036854775808ms",), ("9223372036854775807",), ("9223372036854775s",), ("00000000000005",), ("1" * 40,)]
    got = [r.t for r in spark.createDataFrame(rows, "l string").select(parse_ttl(F.col("l")).alias("t")).collect()]
    assert got == [1_744_675_200_000, 2**63 - 1, None, None, 9_223_372_036_854_775_000, 5000, None]


def test_plans_have_no_nested_loops_and_push_filters(spark):
    eff = effective(spark.read.parquet("/root/testdata/sf0.001/oplog.parquet"))
    plan = changes.current_images(eff.select("store_id", "key", "seq_id", "op_type"), ["store_id", "key"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "PushedFilters: [" in plan
    scanned = plan.split("== Physical Plan ==")[1]
    assert "value" not in scanned.split("ReadSchema")[1].split("\n")[0]
    assert references(spark, "/root/testdata/sf0.001").count() > 0 and targets(spark, "/root/testdata/sf0.001").count() > 0
    assert math.isclose(sum(r.n for r in sketches.cms_table(eff, ["store_id"], "key", 272, 5).groupBy("row").agg(F.sum("n").alias("n")).collect()), 5 * eff.count())


def test_the_package_is_sent_to_workers_once(spark):
    from siltbed import session

    session.ship(spark)
    before = list(spark.sparkContext._python_includes)
    session.ship(spark)
    assert before == spark.sparkContext._python_includes and any(name.startswith("siltbed") for name in before)


def test_a_local_session_without_the_setting_gets_a_folder(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from siltbed.session import scratch, settle\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "print('ROWS', settle(s.range(3), scratch(s, 'x')).count(), scratch(s, 'y'))\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 3 file:" in done.stdout, done.stderr[-2000:]
