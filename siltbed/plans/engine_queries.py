"""The engine's operators as queries over oplog, sst_records, manifests, events and documents.

Keys and values come out in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL, MERGE, PUT, is_reserved
from siltbed.functions.ttl import parse_ttl
from siltbed.operators import backups as lineage
from siltbed.operators import bucket, compaction, folds, history, log, merkle, notify, ordered, resolve, scan, sketches
from siltbed.session import scratch, settle
from siltbed.sources.store import effective, table

#: The moment at which expiry is judged, a sequence id to travel to, and the keys that scans ask for.
NOW_MS, AS_OF = 1_744_675_200_000, 1500
HOT, LOWER, UPPER, PREFIX = b"meta:heartbeat", b"ord:0000", b"sess:8", b"user:4"
SOME_KEYS = [b"meta:heartbeat", b"user:491420", b"no such key"]
PAGE, PAGE_SIZE, DIRECTORY_SIZE = 3, 10, 50
ROWS_PER_FILE, HISTORY = 1000, 3
LAYER_BYTES, LAYER_FACTOR = 4000, 2
BLOOM, CMS, HLL_P = sketches.bloom_size(1000, 0.01), sketches.cms_size(0.01, 0.99), 14
BUCKET_TOKENS, BUCKET_MS = 3, 86_400_000


def _eff(spark: SparkSession, d: str) -> DataFrame:
    return effective(table(spark, d, "oplog"))


def _hexed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.hex(c) for c, kind in df.dtypes if kind == "binary"})


def latest_state(spark, d):
    return _hexed(resolve.state(_eff(spark, d), NOW_MS).drop("expires_at_ms"))


def point_get(spark, d):
    return _hexed(resolve.state(_eff(spark, d).where((F.col("key") == HOT) | (F.col("op_type") == 3)), NOW_MS).where(F.col("key") == HOT).select("store_id", "seq_id", "value"))


def multi_get(spark, d):
    wanted = spark.createDataFrame([(k,) for k in SOME_KEYS], "key binary")
    rows = resolve.state(_eff(spark, d), NOW_MS).join(F.broadcast(wanted), "key", "left_semi")
    return _hexed(rows.select("store_id", "key", "seq_id"))


def as_of_seq(spark, d):
    return _hexed(resolve.state(_eff(spark, d), as_of=AS_OF).select("store_id", "key", "seq_id"))


def raw_scan_all_versions(spark, d):
    rows = ordered.numbered(resolve.versions(_eff(spark, d)), ["store_id"], [F.col("key").asc(), F.col("seq_id").desc()], "position")
    return _hexed(rows.select("store_id", "position", "key", "seq_id", F.col("op_type").cast("int").alias("op_type")))


def merge_iterator_order(spark, d):
    """The log behind the watermark over the files on disk, newest version of each key, in key order."""
    columns = ["store_id", "key", "seq_id", "op_type", "value", "expires_at_ms"]
    tail = _eff(spark, d).join(F.broadcast(log.watermarks(table(spark, d, "wal_manifest"))), "store_id", "left").where("seq_id > coalesce(watermark, -1)")
    both = tail.select(columns).unionByName(table(spark, d, "sst_records").select(columns))
    top = resolve.newest(both).where(F.col("op_type") != DEL)
    kept = resolve.with_cover(top, resolve.tombstones(both)).where("cover_seq is null")
    rows = ordered.numbered(kept.select("store_id", "key", "seq_id"), ["store_id"], [F.col("key").asc()], "position")
    return _hexed(rows)


def user_keys_only(spark, d):
    rows = resolve.newest(_eff(spark, d)).where(~is_reserved(F.col("key")))
    return _hexed(rows.select("store_id", "key", "seq_id", F.col("op_type").cast("int").alias("op_type")))


def range_scan(spark, d):
    return _hexed(scan.range_scan(resolve.state(_eff(spark, d), NOW_MS), LOWER, UPPER).select("store_id", "key", "seq_id"))


def range_scan_page(spark, d):
    """One page of every store."""
    return _hexed(scan.store_pages(scan.range_scan(resolve.state(_eff(spark, d), NOW_MS), LOWER, UPPER), PAGE, PAGE_SIZE).select("store_id", "key", "seq_id", "value"))


def prefix_scan(spark, d):
    return _hexed(scan.prefix_scan(resolve.state(_eff(spark, d), NOW_MS), PREFIX).select("store_id", "key", "seq_id"))


def prefix_scan_page(spark, d):
    """One page of every store."""
    return _hexed(scan.store_pages(scan.prefix_scan(resolve.state(_eff(spark, d), NOW_MS), PREFIX), PAGE, PAGE_SIZE).select("store_id", "key", "seq_id", "value"))


def range_iterate(spark, d):
    rows = scan.range_scan(resolve.state(_eff(spark, d), NOW_MS), LOWER, UPPER).select("store_id", "key", "seq_id")
    return _hexed(ordered.numbered(rows, ["store_id"], [F.col("key").asc()], "position"))


def page_directory(spark, d):
    return _hexed(scan.page_directory(resolve.state(_eff(spark, d), NOW_MS), DIRECTORY_SIZE))


def page_dirty(spark, d):
    """Pages of the state at a sequence id, and whether a later put, delete or range delete fell between a page's first and last key."""
    return scan.dirty_pages(_eff(spark, d), AS_OF, DIRECTORY_SIZE)


def range_delete_visible(spark, d):
    return _hexed(resolve.state(_eff(spark, d)).select("store_id", "key", "seq_id"))


def range_tombstone_fragments(spark, d):
    return _hexed(resolve.fragments(resolve.tombstones(_eff(spark, d))))


def covered_keys_anti_join(spark, d):
    eff = _eff(spark, d)
    rows = resolve.with_cover(resolve.newest(eff).where(F.col("op_type") == PUT), resolve.tombstones(eff)).where("cover_seq is not null")
    return _hexed(rows.select("store_id", "key", "seq_id", "cover_seq"))


def ttl_visible(spark, d):
    return _hexed(resolve.state(_eff(spark, d), NOW_MS).where("coalesce(expires_at_ms, 0) != 0").select("store_id", "key", "seq_id", "expires_at_ms"))


def ttl_remaining(spark, d):
    rows = resolve.state(_eff(spark, d), NOW_MS)
    return _hexed(rows.select("store_id", "key", (F.nullif("expires_at_ms", F.lit(0)) - NOW_MS).alias("remaining_ms")))


def ttl_index(spark, d):
    """Entries with an expiry that has not passed, in every file on disk."""
    rows = table(spark, d, "sst_records").where(F.col("expires_at_ms") > NOW_MS)
    return _hexed(rows.select("store_id", "file_name", "entry_no", "key", "expires_at_ms"))


def ttl_expiry_events(spark, d):
    """A delete event for each key whose newest version has expired; versions replaced before are silent."""
    rows = resolve.state(_eff(spark, d)).where(~resolve.not_expired(NOW_MS))
    return _hexed(rows.select("store_id", "key", "seq_id", F.lit("DELETE").alias("type"), F.col("expires_at_ms").alias("at_ms")))


def expire_existing_keys(spark, d):
    """Records that give the visible keys of a prefix an expiry one hour on: new sequence ids behind the store's highest."""
    eff = _eff(spark, d)
    rows = scan.prefix_scan(resolve.state(eff, NOW_MS), PREFIX).select("store_id", "key", "value")
    top = eff.groupBy("store_id").agg(F.max("seq_id").alias("top"))
    new = ordered.numbered(rows, ["store_id"], [F.col("key").asc()], "n").join(F.broadcast(top), "store_id")  # a row a store
    return _hexed(new.select("store_id", (F.col("top") + F.col("n") + 1).alias("seq_id"), "key", "value", F.lit(NOW_MS + 3_600_000).alias("expires_at_ms")))


def parse_ttl_literals(spark, d):
    events = table(spark, d, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ms", "s", "min", "h", "D", "M", "Y", "", "x")]), (F.col("event_id") % 9 + 1).cast("int"))
    return events.select("event_id", F.concat(F.col("user_id").cast("string"), unit).alias("literal")).withColumn("ttl_ms", parse_ttl(F.col("literal")))


def get_versions(spark, d):
    return _hexed(history.history(_eff(spark, d)).select("store_id", "key", "version", "seq_id"))


def get_version_n(spark, d):
    return _hexed(history.newest_versions(_eff(spark, d), 2).where("version = 1").select("store_id", "key", "seq_id", "value"))


def versions_top_n(spark, d):
    return _hexed(history.newest_versions(_eff(spark, d), HISTORY).select("store_id", "key", "version", "seq_id"))


def version_diff(spark, d):
    rows = history.differences(_eff(spark, d))
    return _hexed(rows.select("store_id", "key", "version", "seq_id", "old_seq", (F.length("value") - F.length("old_value")).alias("longer_by"), F.col("value").eqNullSafe(F.col("old_value")).alias("same_value")))


def snapshot_versions(spark, d):
    """Versions kept for snapshots of the keys of all log segments, taken at a sequence id."""
    eff = _eff(spark, d)
    keys = eff.where("op_type = 0").select("store_id", "key").distinct().withColumn("since_seq", F.lit(AS_OF).cast("long"))
    return _hexed(history.kept_by_snapshots(eff, keys).select("store_id", "key", "seq_id"))


def batch_write_atomic(spark, d):
    return log.batches(table(spark, d, "oplog"), PUT)


def batch_delete_atomic(spark, d):
    return log.batches(table(spark, d, "oplog"), DEL)


def wal_committed_txns(spark, d):
    return log.transactions(table(spark, d, "oplog"))


def wal_replay_after_watermark(spark, d):
    rows = log.replay(table(spark, d, "oplog"), table(spark, d, "wal_manifest"))
    return _hexed(rows.select("store_id", "seq_id", F.col("op_type").cast("int").alias("op_type"), "key"))


def flush_summary(spark, d):
    return compaction.flush_plan(_eff(spark, d), ROWS_PER_FILE)


def sstable_metadata(spark, d):
    return compaction.file_metadata(table(spark, d, "sst_records"))


def list_sstables(spark, d):
    return _hexed(compaction.listed(table(spark, d, "sstable_manifest")))


def compaction_candidates(spark, d):
    return compaction.leveled_plan(table(spark, d, "sstable_manifest"))


def compaction_size_tiered_plan(spark, d):
    return compaction.size_tiered_plan(table(spark, d, "sstable_manifest"))


def compaction_overflow_plan(spark, d):
    return compaction.overflow_plan(table(spark, d, "sstable_manifest"), LAYER_BYTES, LAYER_FACTOR)


def wal_segment_gc(spark, d):
    return log.segments(table(spark, d, "oplog"), table(spark, d, "wal_manifest"))


def _merged(spark, d, **how):
    rows = compaction.merged(table(spark, d, "sst_records"), table(spark, d, "sstable_manifest"), **how)
    return rows.withColumn("op_type", F.col("op_type").cast("int"))


def compact_partial(spark, d):
    """The two upper layers merged: deletes and range deletes stay, as older versions may lie deeper."""
    rows = _merged(spark, d, layers=[0, 1], drop_tombstones=False)
    return _hexed(rows.select("store_id", "key", "seq_id", "op_type", F.when(F.col("op_type") == 3, F.col("value")).alias("end_key")))


def compact_partial_state(spark, d):
    """The visible state of the two upper layers merged, over the other layers as they are: that of all files."""
    upper = _merged(spark, d, layers=[0, 1], drop_tombstones=False)
    both = upper.unionByName(compaction.rest(table(spark, d, "sst_records"), table(spark, d, "sstable_manifest"), [0, 1]).select(*upper.columns))
    return _hexed(resolve.state(both).select("store_id", "key", "seq_id"))


def compact_full(spark, d):
    return _hexed(_merged(spark, d).select("store_id", "key", "seq_id", "op_type"))


def compact_expired(spark, d):
    """All layers merged at a moment: expired versions go as well."""
    return _hexed(_merged(spark, d, now_ms=NOW_MS).select("store_id", "key", "seq_id", "op_type"))


def merkle_root(spark, d):
    return merkle.roots(merkle.leaves(table(spark, d, "sst_records")))


def merkle_validate(spark, d):
    """The files on disk against themselves with some values lost."""
    records = table(spark, d, "sst_records")
    hurt = records.withColumn("value", F.when(F.col("seq_id") % 97 == 0, F.lit(None).cast("binary")).otherwise(F.col("value")))
    return merkle.corrupted(merkle.leaves(records), merkle.leaves(hurt))


def merkle_proof(spark, d):
    """The proofs of all leaves of all files."""
    return merkle.proofs(merkle.leaves(table(spark, d, "sst_records"))).select("store_id", "file_name", "i", F.posexplode("siblings").alias("level", "sibling"))


def merkle_verify(spark, d):
    """Per file, leaves and proofs that lead to its root."""
    leaf = settle(merkle.leaves(table(spark, d, "sst_records")), scratch(spark, "leaves"))
    return merkle.verified(merkle.proofs(leaf), merkle.roots(leaf))


def _puts(spark, d):
    return table(spark, d, "oplog").where("rec_type in (0, 2) and op_type = 0").select("store_id", "key")


def bloom_params(spark, d):
    rows = [(n, p, *sketches.bloom_size(n, p)) for n, p in ((1000, 0.01), (100, 0.001), (0, 0.5), (50, 2.0))]
    return spark.createDataFrame(rows, "n long, p double, m long, k long")


def bloom_bits(spark, d):
    return sketches.bloom_bits(_puts(spark, d), ["store_id"], "key", *BLOOM)


def bloom_contains(spark, d):
    bits = sketches.bloom_bits(_puts(spark, d), ["store_id"], "key", *BLOOM)
    deleted = table(spark, d, "oplog").where("rec_type in (0, 2) and op_type = 1").select("store_id", "key")
    return _hexed(sketches.bloom_contains(deleted, ["store_id"], "key", bits, *BLOOM))


def bloom_merge(spark, d):
    return sketches.bloom_bits(_puts(spark, d), ["store_id"], "key", *BLOOM).select("bit").distinct()


def cms_params(spark, d):
    rows = [(a, c, *sketches.cms_size(a, c)) for a, c in ((0.01, 0.99), (0.001, 0.999), (0.0001, 0.9999), (5.0, -1.0))]
    return spark.createDataFrame(rows, "accuracy double, confidence double, m long, k long")


def cms_table(spark, d):
    return sketches.cms_table(_puts(spark, d), ["store_id"], "key", *CMS)


def cms_estimate(spark, d):
    puts = _puts(spark, d)
    return _hexed(sketches.cms_estimate(puts, ["store_id"], "key", sketches.cms_table(puts, ["store_id"], "key", *CMS), *CMS))


def cms_merge(spark, d):
    return sketches.cms_table(_puts(spark, d), ["store_id"], "key", *CMS).groupBy("row", "col").agg(F.sum("n").alias("n"))


def hll_params(spark, d):
    rows = [(p, 1 << p, 1.04 / (1 << p) ** 0.5) for p in range(4, 19)]
    return spark.createDataFrame(rows, "p int, m long, standard_error double")


def hll_registers(spark, d):
    return sketches.hll_registers(_puts(spark, d), ["store_id"], "key", HLL_P)


def hll_count(spark, d):
    return sketches.hll_count(hll_registers(spark, d), ["store_id"], HLL_P)


def hll_merge(spark, d):
    merged = hll_registers(spark, d).groupBy("idx").agg(F.max("rank").alias("rank"))
    return sketches.hll_count(merged, [], HLL_P)


def simhash_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(sketches.tokens(F.col("text"))).alias("token"))
    return docs.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def _prints(spark, d):
    return sketches.simhash(table(spark, d, "documents"), "doc_id", "text")


def simhash_fingerprint(spark, d):
    return _prints(spark, d)


def simhash_distance(spark, d):
    """Of every answer, the distance to its question."""
    docs = table(spark, d, "documents").where("parent_id is not null").select("doc_id", "parent_id")
    prints = _prints(spark, d)
    a, b = prints.toDF("doc_id", "a_hi", "a_lo"), prints.toDF("parent_id", "b_hi", "b_lo")
    both = docs.join(a, "doc_id").join(b, "parent_id")
    return both.select("doc_id", "parent_id", sketches.hamming(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")).cast("int").alias("distance"))


def simhash_hex(spark, d):
    return _prints(spark, d).select("doc_id", F.lower(F.concat(F.lpad(F.hex("hi"), 8, "0"), F.lpad(F.hex("lo"), 8, "0"))).alias("fingerprint"))


def simhash_near_dups(spark, d):
    """Pairs of different fingerprints within three bits."""
    return sketches.near_fingerprints(_prints(spark, d))


def simhash_classes(spark, d):
    """Every document with the smallest id of its fingerprint, the class of equal token counts."""
    prints = _prints(spark, d)
    first = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    return prints.join(first, ["hi", "lo"]).select("doc_id", "class_id", "members")


def merge_fold(spark, d):
    """Folded state of every sketch, as the number of its cells and a digest; errors for operands without a base."""
    return _hexed(folds.digests(folds.fold(_eff(spark, d))))


def sketch_catalog(spark, d):
    """Sketches by store and name: kind, operations, and whether the last one deleted it."""
    rows = _eff(spark, d).where(is_reserved(F.col("key")) & (F.length("key") >= 2) & F.col("op_type").isin(PUT, DEL, MERGE)).select("store_id", "key", "seq_id", "op_type").distinct()
    per = rows.groupBy("store_id", "key").agg(F.count("*").alias("operations"), F.max("seq_id").alias("last_seq"), F.max_by("op_type", "seq_id").alias("last_op"))
    kind = F.conv(F.hex(F.substring(F.col("key"), 2, 1)), 16, 10).cast("int")
    return per.select("store_id", kind.alias("kind"), F.hex(F.expr("substring(key, 3)")).alias("name"), "operations", "last_seq", (F.col("last_op") == DEL).alias("deleted"))


def _subscriptions(spark):
    """Twenty listeners over parts of the key space; two are open at an end."""
    rows = [(i, f"user:{i * 5:02d}".encode(), f"user:{i * 5 + 7:02d}".encode()) for i in range(18)] + [(18, b"", b"meta:z"), (19, b"sess:f", b"")]
    return spark.createDataFrame(rows, "listener_id long, lower binary, upper binary")


def notify_point_events(spark, d):
    rows = notify.point_events(_eff(spark, d).select("store_id", "seq_id", "op_type", "key", "value").distinct(), _subscriptions(spark))
    return _hexed(rows.groupBy("listener_id", "type").agg(F.count("*").alias("events"), F.min("key").alias("first_key"), F.max("key").alias("last_key")))


def notify_range_events(spark, d):
    rows = notify.range_events(_eff(spark, d).select("store_id", "seq_id", "op_type", "key", "value").distinct(), _subscriptions(spark))
    return _hexed(rows.groupBy("listener_id", "type").agg(F.count("*").alias("events"), F.min("key").alias("first_key"), F.max("value").alias("last_key")))


def token_bucket_admission(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("bucket"), F.col("event_id").alias("call_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return bucket.admissions(calls, BUCKET_TOKENS, BUCKET_MS)


def _backups(spark, d):
    return lineage.distinct_backups(table(spark, d, "backups"))


def backup_incremental_files(spark, d):
    return lineage.incremental_files(_backups(spark, d))


def backup_restore_set(spark, d):
    return lineage.restore_set(_backups(spark, d))


def backup_cascade_closure(spark, d):
    return lineage.cascade(_backups(spark, d))


_NAMES = """latest_state point_get multi_get as_of_seq raw_scan_all_versions merge_iterator_order user_keys_only
range_scan range_scan_page prefix_scan prefix_scan_page range_iterate page_directory page_dirty
range_delete_visible range_tombstone_fragments covered_keys_anti_join ttl_visible ttl_remaining ttl_index ttl_expiry_events expire_existing_keys
get_versions get_version_n versions_top_n version_diff snapshot_versions
batch_write_atomic batch_delete_atomic wal_committed_txns wal_replay_after_watermark
flush_summary sstable_metadata list_sstables compaction_candidates compaction_overflow_plan compaction_size_tiered_plan wal_segment_gc compact_partial compact_partial_state compact_full compact_expired merkle_root merkle_validate merkle_proof merkle_verify
bloom_params bloom_bits bloom_contains bloom_merge cms_params cms_table cms_estimate cms_merge hll_params hll_registers hll_count hll_merge
simhash_tokens simhash_fingerprint simhash_distance simhash_hex simhash_near_dups simhash_classes merge_fold sketch_catalog
notify_point_events notify_range_events token_bucket_admission backup_incremental_files backup_restore_set backup_cascade_closure"""
QUERIES = {name: globals()[name] for name in _NAMES.split()} | {"parse_ttl": parse_ttl_literals}

from siltbed.plans.engine_sql import SQL  # noqa: E402, F401
