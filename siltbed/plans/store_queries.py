"""Queries over the store's own tables: orphans, changes, small files, what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import changes, newonly, orphans, smallfiles
from siltbed.session import scratch, settle
from siltbed.sources import store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.replay(store.references(spark, sf_dir), store.targets(spark, sf_dir)).orphans.select("ref_table", "ref_id")


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.daily(orphans.replay(store.references(spark, sf_dir), store.targets(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.current_keys(store.effective(store.table(spark, sf_dir, "oplog"))).select("store_id", "seq_id")


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[smallfiles.CompactedTable, DataFrame, DataFrame]:
    records, manifest = store.table(spark, sf_dir, "sst_records"), store.table(spark, sf_dir, "sstable_manifest")
    compacted = smallfiles.CompactedTable(spark, scratch(spark, "compacted"))
    compacted.compact(records, manifest, relist=lambda: store.table(spark, sf_dir, "sstable_manifest"))
    return compacted, records, manifest


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    compacted, records, manifest = _compacted(spark, sf_dir)
    return compacted.read(records, manifest).select("store_id", "layer", "seq_id").distinct()


def p4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per store and layer: small files listed, and records held after the rewrite."""
    compacted, records, manifest = _compacted(spark, sf_dir)
    held = compacted.read(records, manifest).groupBy("store_id", "layer").agg(F.count("*").alias("records"))
    small = smallfiles.fingerprints(smallfiles.listing(manifest)).select("store_id", "layer", "files", "small")
    return small.join(held, ["store_id", "layer"], "left").na.fill(0, ["records"])


def _new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = settle(newonly.log_items(store.table(spark, sf_dir, "oplog")), scratch(spark, "records"))
    files = newonly.file_items(store.table(spark, sf_dir, "store_files"))
    tracker = newonly.Tracker(spark, scratch(spark, "new"))
    done = newonly.flushed(records, store.table(spark, sf_dir, "flush_runs"))
    tracker.restore(done.unionByName(newonly.backed_up(files, store.table(spark, sf_dir, "backups"))), unique=True)
    return tracker.run(records.unionByName(files.drop("file_name")), unique=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_items(spark, sf_dir).select("kind", "store_id", "item_id")


def p5_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to do, per kind and store."""
    return _new_items(spark, sf_dir).groupBy("kind", "store_id").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


QUERIES = {"p1_found": p1_found, "p1_daily": p1_daily, "p2_found": p2_found, "p4_found": p4_found, "p4_layout": p4_layout, "p5_found": p5_found, "p5_backlog": p5_backlog}

_REFS = """
refs AS (
  SELECT 'sstable_manifest' ref_table, entry_id ref_id, store_id, regexp_extract(base_file_name, '[^/]*$') target, added_at tm
  FROM sstable_manifest WHERE trim(base_file_name) <> ''
  UNION ALL SELECT 'wal_manifest', entry_id, store_id, printf('wal_%06d.log', segment_id), added_at FROM wal_manifest WHERE segment_id IS NOT NULL
  UNION ALL SELECT 'backups', backup_no, store_id, trim(base_id), recorded_at FROM backups WHERE trim(base_id) <> ''
  UNION ALL SELECT 'oplog', delivery_id, store_id, segment_id::VARCHAR, arrived_at FROM oplog WHERE segment_id IS NOT NULL),
stems AS (
  SELECT store_id, created_at, deleted_at, file_name, unnest(range(1, len(string_split(file_name, '.')) + 1)) n FROM store_files WHERE dir = 'data'),
targets AS (
  SELECT 'sstable_manifest' ref_table, store_id, array_to_string(string_split(file_name, '.')[1:n], '.') target, created_at starts, deleted_at ends FROM stems
  UNION ALL SELECT 'wal_manifest', store_id, file_name, created_at, deleted_at FROM store_files WHERE dir = 'wal'
  UNION ALL SELECT 'backups', store_id, id, recorded_at, deleted_at FROM backups
  UNION ALL SELECT 'oplog', store_id, segment_id::VARCHAR, added_at, deleted_at FROM wal_manifest),
orphans AS (
  SELECT ref_table, ref_id, tm FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM targets t WHERE t.ref_table = r.ref_table AND t.store_id = r.store_id AND t.target = r.target
      AND t.starts <= r.tm AND (t.ends IS NULL OR t.ends > r.tm)))"""

_NEW = """
records AS (
  SELECT store_id, seq_id, min(arrived_at) arrived FROM oplog WHERE rec_type IN (0, 2) AND store_id IS NOT NULL AND seq_id IS NOT NULL GROUP BY ALL),
good AS (
  SELECT store_id, flushed_up_to_seq_id mark, max(started_at) started FROM flush_runs WHERE lower(trim(status)) = 'ok' GROUP BY ALL),
saved AS (
  SELECT store_id, regexp_extract(f, '[^/]*$') file_name, max(make_timestamp(ts * 1000000)) taken
  FROM (SELECT store_id, ts, unnest(new_files) f FROM backups WHERE lower(trim(status)) = 'complete') GROUP BY ALL),
fresh AS (
  SELECT 'record' kind, store_id, seq_id item_id FROM records r WHERE NOT EXISTS (
    SELECT 1 FROM good g WHERE g.store_id = r.store_id AND g.mark >= r.seq_id AND g.started >= r.arrived)
  UNION ALL
  SELECT 'file', store_id, file_id FROM store_files f WHERE dir = 'data' AND deleted_at IS NULL AND NOT EXISTS (
    SELECT 1 FROM saved s WHERE s.store_id = f.store_id AND s.file_name = f.file_name AND s.taken >= f.modified_at))"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT ref_table, ref_id FROM orphans",
    "p1_daily": f"""
WITH {_REFS},
days AS (SELECT unnest(range((SELECT date_trunc('day', min(tm)) FROM (SELECT tm FROM refs UNION ALL SELECT starts FROM targets)), (SELECT greatest(max(tm), max(ends), max(starts)) FROM refs, (SELECT max(starts) starts, max(ends) ends FROM targets)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) d),
per_key AS (SELECT ref_table, store_id, target, date_trunc('day', tm) d, count(*) n FROM refs GROUP BY ALL),
keys AS (SELECT DISTINCT ref_table, store_id, target FROM per_key),
waiting AS (
  SELECT k.ref_table, k.store_id, k.target, days.d, sum(p.n) n
  FROM keys k JOIN per_key p USING (ref_table, store_id, target) JOIN days ON p.d <= days.d GROUP BY ALL),
open AS (
  SELECT w.ref_table, w.d, sum(w.n) n FROM waiting w WHERE NOT EXISTS (
    SELECT 1 FROM targets t WHERE t.ref_table = w.ref_table AND t.store_id = w.store_id AND t.target = w.target
      AND t.starts < w.d + INTERVAL 1 DAY AND (t.ends IS NULL OR t.ends >= w.d + INTERVAL 1 DAY)) GROUP BY ALL),
came AS (SELECT ref_table, date_trunc('day', tm) d, count(*) orphans FROM orphans GROUP BY ALL),
tables AS (SELECT DISTINCT ref_table FROM refs),
grid AS (
  SELECT ref_table, d, coalesce(orphans, 0) orphans, coalesce(n, 0) open_at_end
  FROM tables CROSS JOIN days LEFT JOIN came USING (ref_table, d) LEFT JOIN open USING (ref_table, d))
SELECT ref_table, d::DATE AS "day", orphans, open_at_end::BIGINT AS open_at_end
FROM (SELECT *, open_at_end - coalesce(lag(open_at_end) OVER (PARTITION BY ref_table ORDER BY d), 0) opened FROM grid)
WHERE orphans <> 0 OR opened <> 0""",
    "p2_found": """
WITH eff AS (
  SELECT DISTINCT store_id, seq_id, op_type, key, value FROM oplog o
  WHERE rec_type = 0 OR rec_type = 2 AND EXISTS (SELECT 1 FROM oplog c WHERE c.rec_type = 3 AND c.store_id = o.store_id AND c.txn_id = o.txn_id)),
newest AS (
  SELECT store_id, key, max(seq_id) seq_id, arg_max(op_type, seq_id) op_type FROM eff
  WHERE op_type IN (0, 1) AND hex(key)[1:2] <> '01' GROUP BY store_id, key)
SELECT store_id, seq_id FROM newest n WHERE op_type = 0 AND NOT EXISTS (
  SELECT 1 FROM eff r WHERE r.op_type = 3 AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.key BETWEEN r.key AND r.value)""",
    "p4_found": """
SELECT DISTINCT m.store_id, m.layer, s.seq_id FROM sst_records s JOIN sstable_manifest m
ON m.store_id = s.store_id AND regexp_extract(m.base_file_name, '[^/]*$') = s.file_name WHERE m.removed_at IS NULL""",
    "p4_layout": """
WITH listed AS (
  SELECT store_id, layer, regexp_extract(base_file_name, '[^/]*$') file_name, max(size_bytes) size_bytes FROM sstable_manifest
  WHERE removed_at IS NULL AND trim(base_file_name) <> '' GROUP BY ALL),
held AS (SELECT store_id, layer, count(DISTINCT seq_id) records FROM listed JOIN sst_records USING (store_id, file_name) GROUP BY ALL),
parts AS (SELECT store_id, layer, count(*) files, count(*) FILTER (size_bytes < 1048576) small FROM listed GROUP BY ALL)
SELECT store_id, layer, files, small, coalesce(records, 0) AS records FROM parts LEFT JOIN held USING (store_id, layer)""",
    "p5_found": f"WITH {_NEW} SELECT kind, store_id, item_id FROM fresh",
    "p5_backlog": f"WITH {_NEW} SELECT kind, store_id, count(*) AS items, min(item_id) AS first_item, max(item_id) AS last_item FROM fresh GROUP BY kind, store_id",
}
