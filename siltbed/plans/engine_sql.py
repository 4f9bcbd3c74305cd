"""The SQL of the engine's queries: DuckDB on the same tables must give the same rows."""

from __future__ import annotations

NOW, AS_OF = 1744675200000, 1500
HOT, LOWER, UPPER, PREFIX = "6D6574613A686561727462656174", "6F72643A30303030", "736573733A38", "757365723A34"

# Keys are compared in hexadecimal, which has the order of the bytes.
_EFF = """
eff AS (
  SELECT DISTINCT store_id, seq_id, op_type, key, value, expires_at_ms, hex(key) k, hex(value) v FROM oplog o
  WHERE rec_type = 0 OR rec_type = 2 AND EXISTS (SELECT 1 FROM oplog c WHERE c.rec_type = 3 AND c.store_id = o.store_id AND c.txn_id = o.txn_id))"""


def _state(name: str, now: int | None = None, as_of: int | None = None) -> str:
    upto = "" if as_of is None else f" AND seq_id <= {as_of}"
    live = "" if now is None else f" AND (coalesce(n.expires_at_ms, 0) = 0 OR n.expires_at_ms > {now})"
    return f"""
{name}_newest AS (
  SELECT * FROM eff WHERE op_type IN (0, 1, 2){upto} QUALIFY row_number() OVER (PARTITION BY store_id, k ORDER BY seq_id DESC) = 1),
{name} AS (
  SELECT store_id, k, seq_id, v, expires_at_ms FROM {name}_newest n WHERE op_type = 0 AND k[1:2] <> '01'{live} AND NOT EXISTS (
    SELECT 1 FROM eff r WHERE r.op_type = 3{upto} AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.k BETWEEN r.k AND r.v))"""


_NOW = f"WITH {_EFF}, {_state('state', now=NOW)}"
_ALL = f"WITH {_EFF}, {_state('state')}"
_OLD = f"WITH {_EFF}, {_state('state', as_of=AS_OF)}"
_HISTORY = f"""WITH {_EFF}, hist AS (
  SELECT *, row_number() OVER (PARTITION BY store_id, k ORDER BY seq_id DESC) - 1 AS version FROM eff WHERE op_type IN (0, 2))"""
_PAGE = "QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY k) BETWEEN 31 AND 40"
_LISTED = """
listed AS (
  SELECT store_id, layer, regexp_extract(base_file_name, '[^/]*$') file_name, max(size_bytes) size_bytes, min(hex(min_key)) min_key, max(hex(max_key)) max_key
  FROM sstable_manifest WHERE removed_at IS NULL AND trim(base_file_name) <> '' GROUP BY ALL)"""
_DIRECTORY = """
pages AS (
  SELECT store_id, (n // 50)::BIGINT page, min(k) first_key, max(k) last_key, count(*) AS rows, max(seq_id) top_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY k) - 1 AS n FROM state) GROUP BY ALL)"""


def _merged(layers: str, tombstones: str, live: str = "true") -> str:
    """Newest user versions, newest or unfoldable sketch records, and optionally the range deletes that are the newest at some edge in their span."""
    return f"""
WITH {_LISTED},
recs AS (SELECT DISTINCT s.store_id, seq_id, op_type, expires_at_ms, hex(key) k, hex(value) v FROM sst_records s JOIN listed USING (store_id, file_name) WHERE {layers}),
newest AS (SELECT * FROM recs WHERE op_type IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY store_id, k ORDER BY seq_id DESC) = 1),
sk AS (
  SELECT store_id, k, min(seq_id) FILTER (v[1:2] = '00') first_base, min(seq_id) FILTER (v[1:2] = 'FF') first_operand FROM recs
  WHERE op_type = 2 AND k[1:2] = '01' GROUP BY store_id, k),
bad AS (SELECT store_id, k FROM sk WHERE k[3:4] <> '04' AND first_operand IS NOT NULL AND (first_base IS NULL OR first_operand < first_base)),
t AS (SELECT DISTINCT store_id, k s, v e, seq_id FROM recs WHERE op_type = 3 AND k <= v),
edges AS (SELECT store_id, s p FROM t UNION SELECT store_id, e || '00' FROM t),
kept AS (
  SELECT store_id, k AS key, seq_id, op_type::INT AS op_type, NULL::VARCHAR AS end_key FROM newest n
  WHERE k[1:2] <> '01' AND {live} AND NOT EXISTS (
    SELECT 1 FROM recs r WHERE r.op_type = 3 AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.k BETWEEN r.k AND r.v)
  UNION ALL SELECT store_id, k, seq_id, op_type, NULL FROM newest n WHERE k[1:2] = '01' AND op_type = 2 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.store_id = n.store_id AND b.k = n.k)
  UNION ALL SELECT DISTINCT store_id, k, seq_id, op_type, NULL FROM recs r WHERE op_type = 2 AND EXISTS (SELECT 1 FROM bad b WHERE b.store_id = r.store_id AND b.k = r.k)
  UNION ALL SELECT DISTINCT t.store_id, t.s, t.seq_id, 3, t.e FROM t JOIN edges x ON x.store_id = t.store_id AND x.p BETWEEN t.s AND t.e
  WHERE {tombstones} AND NOT EXISTS (SELECT 1 FROM t o WHERE o.store_id = t.store_id AND o.seq_id > t.seq_id AND x.p BETWEEN o.s AND o.e))"""


def _hash(value: str, seed: str) -> str:
    return f"('0x' || substr(md5({value} || {seed}), 1, 16))::UBIGINT"


_PUTS = "puts AS (SELECT store_id, key FROM oplog WHERE rec_type IN (0, 2) AND op_type = 0)"
_BITS = f"""
bits AS (SELECT DISTINCT store_id, ({_hash('key', "('siltbed-' || i)::BLOB")} % 9586)::BIGINT AS bit FROM (SELECT DISTINCT store_id, key FROM puts), range(7) t(i))"""
_CELLS = f"""
cells AS (
  SELECT store_id, i::INT AS "row", ({_hash('key', "('siltbed-' || i)::BLOB")} % 272)::BIGINT AS col, sum(n)::BIGINT AS n
  FROM (SELECT store_id, key, count(*) n FROM puts GROUP BY ALL), range(5) t(i) GROUP BY ALL)"""
_REGISTERS = f"""
hashed AS (SELECT DISTINCT store_id, {_hash('key', "'siltbed-0'::BLOB")} h FROM (SELECT DISTINCT store_id, key FROM puts)),
registers AS (
  SELECT store_id, (h >> 50)::BIGINT AS idx, max(CASE WHEN h & 1125899906842623 = 0 THEN 51 ELSE 50 - length(bin((h & 1125899906842623)::BIGINT)) + 1 END)::INT AS rank
  FROM hashed GROUP BY ALL)"""


def _estimate(by: str) -> str:
    source = "registers" if by else "(SELECT idx, max(rank) rank FROM registers GROUP BY idx)"
    group, keep = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""
SELECT {keep}floor(CASE WHEN raw <= 40960 AND zeros > 0 THEN 16384 * ln(16384 / zeros) ELSE raw END + 0.5)::BIGINT AS estimate
FROM (SELECT *, 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + zeros) raw
      FROM (SELECT {keep}16384 - count(*) zeros, sum(pow(2.0, -rank)) s FROM {source} {group}))"""


_TOKENS = r"toks AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')) t FROM documents WHERE text IS NOT NULL) WHERE t <> '')"
_PRINTS = f"""
{_TOKENS},
counted AS (SELECT doc_id, t, count(*) n FROM toks GROUP BY ALL),
hashed AS (SELECT doc_id, n, {_hash("encode(t)", "'siltbed-0'::BLOB")} h FROM counted),
sums AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) s FROM hashed, range(64) r(b) GROUP BY ALL),
prints AS (
  SELECT d.doc_id, coalesce(sum(CASE WHEN b >= 32 AND s >= 0 THEN 1::BIGINT << (b - 32) ELSE 0 END), 0)::BIGINT hi,
    coalesce(sum(CASE WHEN b < 32 AND s >= 0 THEN 1::BIGINT << b ELSE 0 END), 0)::BIGINT lo
  FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id)"""
_LEAVES = """
leaves AS (
  SELECT store_id, file_name, row_number() OVER (PARTITION BY store_id, file_name ORDER BY entry_no) - 1 AS i, seq_id,
    sha256(concat_ws('|', seq_id, op_type, hex(key), coalesce(hex(value), '-'))) h,
    sha256(concat_ws('|', seq_id, op_type, hex(key), coalesce(CASE WHEN seq_id % 97 = 0 THEN NULL ELSE hex(value) END, '-'))) hurt
  FROM sst_records)"""
_TREE = f"""
{_LEAVES},
tree AS (
  SELECT store_id, file_name, 0 AS height, list(h ORDER BY i) hs FROM leaves GROUP BY store_id, file_name
  UNION ALL
  SELECT store_id, file_name, height + 1, list_transform(range(0, len(hs), 2), lambda j: sha256(unhex(hs[j + 1]) || unhex(coalesce(hs[j + 2], hs[j + 1])))) FROM tree WHERE len(hs) > 1)"""
_SUBS = """
subs AS (
  SELECT i AS listener_id, printf('user:%02d', i * 5) lower, printf('user:%02d', i * 5 + 7) upper FROM range(18) t(i)
  UNION ALL VALUES (18, '', 'meta:z'), (19, 'sess:f', '')),
hexsubs AS (SELECT listener_id, hex(lower) lo, hex(upper) up FROM subs)"""
_BACKUPS = """
b AS (
  SELECT store_id, id, nullif(trim(base_id), '') base_id, ts, files FROM backups WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY store_id, id ORDER BY recorded_at DESC, backup_no DESC) = 1),
lineage AS (
  SELECT store_id, id, id AS ancestor FROM b
  UNION
  SELECT l.store_id, l.id, p.base_id FROM lineage l JOIN b p ON p.store_id = l.store_id AND p.id = l.ancestor JOIN b q ON q.store_id = p.store_id AND q.id = p.base_id),
own AS (SELECT DISTINCT store_id, id, regexp_extract(f, '[^/]*$') file FROM (SELECT store_id, id, unnest(files) f FROM b) WHERE trim(regexp_extract(f, '[^/]*$')) <> '')"""


def _batches(op: int) -> str:
    return f"""
SELECT store_id, txn_id, count(*) AS records, min(seq_id) AS first_seq, max(seq_id) AS last_seq
FROM (SELECT DISTINCT store_id, txn_id, seq_id, op_type, key FROM oplog o WHERE rec_type = 2 AND EXISTS (
  SELECT 1 FROM oplog c WHERE c.rec_type = 3 AND c.store_id = o.store_id AND c.txn_id = o.txn_id))
GROUP BY store_id, txn_id HAVING count(*) FILTER (op_type <> {op} OR octet_length(key) = 0 OR hex(key)[1:2] = '01') = 0"""


SQL = {
    "latest_state": f"{_NOW} SELECT store_id, k AS key, seq_id, v AS value FROM state",
    "point_get": f"{_NOW} SELECT store_id, seq_id, v AS value FROM state WHERE k = '{HOT}'",
    "multi_get": f"{_NOW} SELECT store_id, k AS key, seq_id FROM state WHERE k IN ('{HOT}', hex('user:491420'), hex('no such key'))",
    "as_of_seq": f"{_OLD} SELECT store_id, k AS key, seq_id FROM state",
    "raw_scan_all_versions": f"""WITH {_EFF}
SELECT store_id, row_number() OVER (PARTITION BY store_id ORDER BY k, seq_id DESC) - 1 AS position, k AS key, seq_id, op_type::INT AS op_type FROM eff WHERE op_type IN (0, 1, 2)""",
    "merge_iterator_order": f"""WITH {_EFF},
marks AS (SELECT store_id, max(flushed_up_to_seq_id) mark FROM wal_manifest WHERE deleted_at IS NULL GROUP BY 1),
both_ AS (
  SELECT store_id, seq_id, op_type, k, v FROM eff LEFT JOIN marks USING (store_id) WHERE seq_id > coalesce(mark, -1)
  UNION SELECT store_id, seq_id, op_type, hex(key), hex(value) FROM sst_records),
newest AS (SELECT * FROM both_ WHERE op_type IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY store_id, k ORDER BY seq_id DESC) = 1)
SELECT store_id, k AS key, seq_id, row_number() OVER (PARTITION BY store_id ORDER BY k) - 1 AS position FROM newest n WHERE op_type <> 1 AND NOT EXISTS (
  SELECT 1 FROM both_ r WHERE r.op_type = 3 AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.k BETWEEN r.k AND r.v)""",
    "user_keys_only": f"{_ALL} SELECT store_id, k AS key, seq_id, op_type::INT AS op_type FROM state_newest WHERE k[1:2] <> '01'",
    "range_scan": f"{_NOW} SELECT store_id, k AS key, seq_id FROM state WHERE k BETWEEN '{LOWER}' AND '{UPPER}'",
    "range_scan_page": f"{_NOW} SELECT store_id, k AS key, seq_id, v AS value FROM state WHERE k BETWEEN '{LOWER}' AND '{UPPER}' {_PAGE}",
    "prefix_scan": f"{_NOW} SELECT store_id, k AS key, seq_id FROM state WHERE starts_with(k, '{PREFIX}')",
    "prefix_scan_page": f"{_NOW} SELECT store_id, k AS key, seq_id, v AS value FROM state WHERE starts_with(k, '{PREFIX}') {_PAGE}",
    "range_iterate": f"{_NOW} SELECT store_id, k AS key, seq_id, row_number() OVER (PARTITION BY store_id ORDER BY k) - 1 AS position FROM state WHERE k BETWEEN '{LOWER}' AND '{UPPER}'",
    "page_directory": f"{_NOW}, {_DIRECTORY} SELECT * FROM pages",
    "page_dirty": f"""{_OLD}, {_DIRECTORY},
changed AS (SELECT DISTINCT store_id, k FROM eff WHERE seq_id > {AS_OF} AND op_type IN (0, 1)),
wiped AS (SELECT p.store_id, page FROM pages p JOIN eff r ON r.op_type = 3 AND r.seq_id > {AS_OF} AND r.store_id = p.store_id AND r.k <= r.v AND r.k <= p.last_key AND r.v >= p.first_key GROUP BY ALL)
SELECT p.store_id, p.page, count(c.k) AS changed_keys, count(c.k) > 0 OR any_value(w.page) IS NOT NULL AS dirty
FROM pages p LEFT JOIN changed c ON c.store_id = p.store_id AND c.k BETWEEN p.first_key AND p.last_key
LEFT JOIN wiped w ON w.store_id = p.store_id AND w.page = p.page GROUP BY p.store_id, p.page""",
    "range_delete_visible": f"{_ALL} SELECT store_id, k AS key, seq_id FROM state",
    "range_tombstone_fragments": f"""WITH {_EFF},
t AS (SELECT DISTINCT store_id, k s, v e, seq_id FROM eff WHERE op_type = 3 AND k <= v),
edges AS (SELECT store_id, s p FROM t UNION SELECT store_id, e || '00' FROM t),
pieces AS (SELECT store_id, p, lead(p) OVER (PARTITION BY store_id ORDER BY p) past FROM edges)
SELECT p.store_id, p.p AS start_key, p.past AS past_key, max(t.seq_id) AS seq_id FROM pieces p JOIN t ON t.store_id = p.store_id AND p.p BETWEEN t.s AND t.e
WHERE past IS NOT NULL GROUP BY ALL""",
    "covered_keys_anti_join": f"""{_ALL}
SELECT n.store_id, n.k AS key, n.seq_id, max(r.seq_id) AS cover_seq FROM state_newest n JOIN eff r
ON r.op_type = 3 AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.k BETWEEN r.k AND r.v WHERE n.op_type = 0 GROUP BY ALL""",
    "ttl_visible": f"{_NOW} SELECT store_id, k AS key, seq_id, expires_at_ms FROM state WHERE coalesce(expires_at_ms, 0) <> 0",
    "ttl_remaining": f"{_NOW} SELECT store_id, k AS key, nullif(expires_at_ms, 0) - {NOW} AS remaining_ms FROM state",
    "ttl_index": f"SELECT store_id, file_name, entry_no, hex(key) AS key, expires_at_ms FROM sst_records WHERE expires_at_ms > {NOW}",
    "ttl_expiry_events": f"{_ALL} SELECT store_id, k AS key, seq_id, 'DELETE' AS type, expires_at_ms AS at_ms FROM state WHERE coalesce(expires_at_ms, 0) <> 0 AND expires_at_ms <= {NOW}",
    "expire_existing_keys": f"""{_NOW}, tops AS (SELECT store_id, max(seq_id) top FROM eff GROUP BY 1)
SELECT store_id, top + row_number() OVER (PARTITION BY store_id ORDER BY k) AS seq_id, k AS key, v AS value, {NOW} + 3600000 AS expires_at_ms
FROM state JOIN tops USING (store_id) WHERE starts_with(k, '{PREFIX}')""",
    "parse_ttl": """
WITH l AS (SELECT event_id, user_id, ['ms', 's', 'min', 'h', 'D', 'M', 'Y', '', 'x'][event_id % 9 + 1] u FROM events)
SELECT event_id, user_id || u AS literal, user_id * CASE u WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN '' THEN 1000 WHEN 'min' THEN 60000 WHEN 'h' THEN 3600000
  WHEN 'D' THEN 86400000 WHEN 'M' THEN 2592000000 WHEN 'Y' THEN 31536000000 END AS ttl_ms FROM l""",
    "get_versions": f"{_HISTORY} SELECT store_id, k AS key, version, seq_id FROM hist",
    "get_version_n": f"{_HISTORY} SELECT store_id, k AS key, seq_id, v AS value FROM hist WHERE version = 1",
    "versions_top_n": f"{_HISTORY} SELECT store_id, k AS key, version, seq_id FROM hist WHERE version < 3",
    "version_diff": f"""{_HISTORY}
SELECT a.store_id, a.k AS key, a.version, a.seq_id, b.seq_id AS old_seq, (octet_length(a.value) - octet_length(b.value))::INT AS longer_by, a.v IS NOT DISTINCT FROM b.v AS same_value
FROM hist a LEFT JOIN hist b ON a.store_id = b.store_id AND a.k = b.k AND b.version = a.version + 1""",
    "snapshot_versions": f"""WITH {_EFF},
snaps AS (SELECT DISTINCT store_id, hex(key) k FROM oplog o WHERE op_type = 0 AND (rec_type = 0 OR rec_type = 2 AND EXISTS (
  SELECT 1 FROM oplog c WHERE c.rec_type = 3 AND c.store_id = o.store_id AND c.txn_id = o.txn_id))),
each_ AS (SELECT store_id, k, seq_id, max(seq_id) FILTER (seq_id <= {AS_OF}) OVER (PARTITION BY store_id, k) base FROM eff JOIN snaps USING (store_id, k) WHERE op_type IN (0, 1, 2))
SELECT store_id, k AS key, seq_id FROM each_ WHERE seq_id > {AS_OF} OR seq_id = base""",
    "batch_write_atomic": _batches(0),
    "batch_delete_atomic": _batches(1),
    "wal_committed_txns": """
SELECT store_id, txn_id, count(DISTINCT seq_id) FILTER (rec_type = 2) AS records, min(seq_id) FILTER (rec_type = 2) AS first_seq,
  max(seq_id) FILTER (rec_type = 2) AS last_seq, bool_or(rec_type = 3) AS committed FROM oplog WHERE txn_id IS NOT NULL GROUP BY store_id, txn_id""",
    "wal_replay_after_watermark": f"""WITH {_EFF},
marks AS (SELECT store_id, max(flushed_up_to_seq_id) mark FROM wal_manifest WHERE deleted_at IS NULL GROUP BY 1)
SELECT store_id, seq_id, op_type::INT AS op_type, k AS key FROM eff LEFT JOIN marks USING (store_id) WHERE seq_id > coalesce(mark, -1)""",
    "flush_summary": f"""WITH {_EFF}
SELECT store_id, ((seq_id - 1) // 1000)::BIGINT AS file_no, count(*) AS records, count(*) FILTER (op_type = 1) AS deletes, min(k) AS min_key, max(k) AS max_key,
  min(seq_id) AS min_seq, max(seq_id) AS max_seq FROM eff WHERE op_type IN (0, 1, 2) GROUP BY ALL""",
    "sstable_metadata": """
SELECT store_id, file_name, count(*) AS records, count(DISTINCT seq_id) AS distinct_records, count(*) FILTER (op_type = 1) AS deletes,
  min(hex(key)) AS min_key, max(hex(key)) AS max_key, min(seq_id) AS min_seq, max(seq_id) AS max_seq FROM sst_records GROUP BY store_id, file_name""",
    "list_sstables": f"WITH {_LISTED} SELECT * FROM listed",
    "compaction_candidates": f"""WITH {_LISTED},
first AS (SELECT store_id, count(*) inputs, min(min_key) lo, max(max_key) hi, sum(size_bytes)::BIGINT bytes FROM listed WHERE layer = 0 GROUP BY 1 HAVING count(*) >= 4)
SELECT f.store_id, inputs, bytes, count(l.file_name) AS overlapping, coalesce(sum(l.size_bytes), 0)::BIGINT AS overlapping_bytes
FROM first f LEFT JOIN listed l ON l.store_id = f.store_id AND l.layer = 1 AND NOT (l.max_key < f.lo OR l.min_key > f.hi) GROUP BY ALL""",
    "compaction_overflow_plan": f"""WITH {_LISTED},
last AS (SELECT store_id, max(layer) last_layer FROM listed GROUP BY 1),
tiers AS (
  SELECT store_id, layer, sum(size_bytes)::BIGINT bytes, (4000 * pow(2, layer - 1))::BIGINT lim, min(file_name) file_name, arg_min(min_key, file_name) lo, arg_min(max_key, file_name) hi
  FROM listed WHERE layer >= 1 GROUP BY store_id, layer)
SELECT t.store_id, t.layer, t.bytes, t.lim AS "limit", t.file_name, count(b.file_name) AS overlapping,
  CASE WHEN t.layer = last_layer THEN 'merge in place' WHEN count(b.file_name) = 0 THEN 'move' ELSE 'merge' END AS action
FROM tiers t JOIN last USING (store_id) LEFT JOIN listed b ON b.store_id = t.store_id AND b.layer = t.layer + 1 AND NOT (b.max_key < t.lo OR b.min_key > t.hi)
WHERE t.bytes >= t.lim GROUP BY t.store_id, t.layer, t.bytes, t.lim, t.file_name, last_layer""",
    "wal_segment_gc": """
WITH marks AS (SELECT store_id, max(flushed_up_to_seq_id) mark FROM wal_manifest WHERE deleted_at IS NULL GROUP BY 1)
SELECT store_id, segment_id, count(*) AS deliveries, min(seq_id) AS min_seq, max(seq_id) AS max_seq, coalesce(max(seq_id) <= any_value(mark), false) AS deletable
FROM oplog LEFT JOIN marks USING (store_id) WHERE segment_id IS NOT NULL GROUP BY store_id, segment_id""",
    "compaction_size_tiered_plan": f"""WITH {_LISTED}, last AS (SELECT store_id, max(layer) last_layer FROM listed GROUP BY 1)
SELECT store_id, layer, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, CASE WHEN layer = last_layer THEN layer ELSE layer + 1 END AS to_layer,
  layer = last_layer AS drops_tombstones FROM listed JOIN last USING (store_id) GROUP BY store_id, layer, last_layer HAVING count(*) >= 4""",
    "compact_partial": f"{_merged('layer IN (0, 1)', 'true')} SELECT * FROM kept",
    "compact_partial_state": f"""WITH {_LISTED},
recs AS (SELECT DISTINCT s.store_id, seq_id, op_type, hex(key) k, hex(value) v FROM sst_records s JOIN listed USING (store_id, file_name)),
newest AS (SELECT * FROM recs WHERE op_type IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY store_id, k ORDER BY seq_id DESC) = 1)
SELECT store_id, k AS key, seq_id FROM newest n WHERE op_type = 0 AND k[1:2] <> '01' AND NOT EXISTS (
  SELECT 1 FROM recs r WHERE r.op_type = 3 AND r.store_id = n.store_id AND r.seq_id > n.seq_id AND n.k BETWEEN r.k AND r.v)""",
    "compact_full": f"{_merged('true', 'false', 'op_type <> 1')} SELECT * EXCLUDE (end_key) FROM kept",
    "compact_expired": f"{_merged('true', 'false', f'op_type <> 1 AND (coalesce(n.expires_at_ms, 0) = 0 OR n.expires_at_ms > {NOW})')} SELECT * EXCLUDE (end_key) FROM kept",
    "merkle_root": f"WITH RECURSIVE {_TREE} SELECT store_id, file_name, height, hs[1] AS root FROM tree WHERE len(hs) = 1",
    "merkle_validate": f"""WITH {_LEAVES}
SELECT store_id, file_name, count(*) FILTER (h <> hurt) = 0 AS valid, count(*) FILTER (h <> hurt) AS bad_blocks, min(i) FILTER (h <> hurt) AS first_bad FROM leaves GROUP BY store_id, file_name""",
    "merkle_proof": f"""WITH RECURSIVE {_TREE}
SELECT t.store_id, t.file_name, l.i, height AS level, coalesce(hs[xor(l.i >> height, 1) + 1], hs[(l.i >> height) + 1]) AS sibling
FROM tree t JOIN leaves l ON l.store_id = t.store_id AND l.file_name = t.file_name WHERE len(hs) > 1""",
    "merkle_verify": "SELECT store_id, file_name, count(*) AS leaves, count(*) AS proven FROM sst_records GROUP BY store_id, file_name",
    "bloom_params": "SELECT * FROM (VALUES (1000::BIGINT, 0.01::DOUBLE, 9586::BIGINT, 7::BIGINT), (100, 0.001, 1438, 10), (0, 0.5, 2, 2), (50, 2.0, 480, 7)) t(n, p, m, k)",
    "bloom_bits": f"WITH {_PUTS}, {_BITS} SELECT * FROM bits",
    "bloom_contains": f"""WITH {_PUTS}, {_BITS},
asked AS (SELECT DISTINCT store_id, key FROM oplog WHERE rec_type IN (0, 2) AND op_type = 1),
want AS (SELECT store_id, key, ({_hash('key', "('siltbed-' || i)::BLOB")} % 9586)::BIGINT AS bit FROM asked, range(7) t(i))
SELECT w.store_id, hex(w.key) AS key, count(*) = count(b.bit) AS contained FROM want w LEFT JOIN bits b ON b.store_id = w.store_id AND b.bit = w.bit GROUP BY w.store_id, w.key""",
    "bloom_merge": f"WITH {_PUTS}, {_BITS} SELECT DISTINCT bit FROM bits",
    "cms_params": """
SELECT a AS accuracy, c AS confidence, m, k FROM (VALUES (0.01::DOUBLE, 0.99::DOUBLE, 272::BIGINT, 5::BIGINT), (0.001, 0.999, 2719, 7), (0.0001, 0.9999, 27183, 10), (5.0, -1.0, 272, 5)) t(a, c, m, k)""",
    "cms_table": f"WITH {_PUTS}, {_CELLS} SELECT * FROM cells",
    "cms_estimate": f"""WITH {_PUTS}, {_CELLS},
want AS (SELECT store_id, key, i::INT AS r, ({_hash('key', "('siltbed-' || i)::BLOB")} % 272)::BIGINT AS col FROM (SELECT DISTINCT store_id, key FROM puts), range(5) t(i))
SELECT w.store_id, hex(w.key) AS key, min(c.n) AS estimate FROM want w JOIN cells c ON c.store_id = w.store_id AND c."row" = w.r AND c.col = w.col GROUP BY w.store_id, w.key""",
    "cms_merge": f'WITH {_PUTS}, {_CELLS} SELECT "row", col, sum(n)::BIGINT AS n FROM cells GROUP BY "row", col',
    "hll_params": "SELECT p::INT AS p, (1 << p)::BIGINT AS m, 1.04 / sqrt(1 << p) AS standard_error FROM range(4, 19) t(p)",
    "hll_registers": f"WITH {_PUTS}, {_REGISTERS} SELECT * FROM registers",
    "hll_count": f"WITH {_PUTS}, {_REGISTERS} {_estimate('store_id')}",
    "hll_merge": f"WITH {_PUTS}, {_REGISTERS} {_estimate('')}",
    "simhash_tokens": f"WITH {_TOKENS} SELECT doc_id, t AS token, count(*) AS n FROM toks GROUP BY doc_id, t",
    "simhash_fingerprint": f"WITH {_PRINTS} SELECT * FROM prints",
    "simhash_distance": f"""WITH {_PRINTS}
SELECT d.doc_id, d.parent_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance
FROM documents d JOIN prints a ON a.doc_id = d.doc_id JOIN prints b ON b.doc_id = d.parent_id""",
    "simhash_hex": f"WITH {_PRINTS} SELECT doc_id, printf('%08x%08x', hi, lo) AS fingerprint FROM prints",
    "simhash_near_dups": f"""WITH {_PRINTS}, f AS (SELECT DISTINCT hi, lo FROM prints)
SELECT a.hi AS a_hi, a.lo AS a_lo, b.hi AS b_hi, b.lo AS b_lo, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance
FROM f a JOIN f b ON (a.hi, a.lo) < (b.hi, b.lo) WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3""",
    "simhash_classes": f"""WITH {_PRINTS}
SELECT doc_id, min(doc_id) OVER (PARTITION BY hi, lo) AS class_id, count(*) OVER (PARTITION BY hi, lo) AS members FROM prints""",
    "merge_fold": f"""WITH {_EFF},
m AS (SELECT store_id, k, ('0x' || k[3:4])::INT kind, seq_id, v[1:2] = '00' is_base, unhex(v[3:]) item FROM eff WHERE op_type = 2 AND k[1:2] = '01' AND length(k) >= 4 AND length(v) > 0),
heads AS (
  SELECT store_id, k, kind, min(seq_id) FILTER (is_base) first_base, max(seq_id) FILTER (is_base) base_seq, min(seq_id) FILTER (NOT is_base) first_operand, max(seq_id) newest_seq, arg_max(item, seq_id) newest
  FROM m GROUP BY store_id, k, kind),
live AS (SELECT m.store_id, m.k, m.kind, item FROM m JOIN heads h ON h.store_id = m.store_id AND h.k = m.k WHERE NOT is_base AND m.seq_id > h.base_seq AND (h.kind = 4 OR h.first_operand > h.first_base)),
counted AS (SELECT store_id, k, kind, item, count(*) n FROM live GROUP BY ALL),
touched AS (
  SELECT store_id, k, ({_hash('item', "('siltbed-' || i)::BLOB")} % 9586)::BIGINT pos, 1::BIGINT n FROM counted, range(7) t(i) WHERE kind = 1
  UNION ALL SELECT store_id, k, i * 272 + ({_hash('item', "('siltbed-' || i)::BLOB")} % 272)::BIGINT, n FROM counted, range(5) t(i) WHERE kind = 2
  UNION ALL SELECT store_id, k, (h >> 50)::BIGINT, CASE WHEN h & 1125899906842623 = 0 THEN 51 ELSE 50 - length(bin((h & 1125899906842623)::BIGINT)) + 1 END
  FROM (SELECT store_id, k, {_hash('item', "'siltbed-0'::BLOB")} h FROM counted WHERE kind = 3)),
cells AS (SELECT store_id, k, pos, CASE WHEN k[3:4] = '02' THEN sum(n)::BIGINT ELSE max(n) END n FROM touched GROUP BY store_id, k, pos),
states AS (SELECT store_id, k, count(*) cells, string_agg(pos || ':' || n, ',' ORDER BY pos) body FROM cells GROUP BY store_id, k),
behind AS (SELECT m.store_id, m.k, count(*) operands FROM m JOIN heads h ON h.store_id = m.store_id AND h.k = m.k WHERE NOT is_base AND m.seq_id > h.base_seq AND m.kind <> 4 AND h.first_operand > h.first_base GROUP BY ALL),
judged AS (SELECT *, CASE WHEN kind NOT BETWEEN 1 AND 4 THEN 'no fold for this kind' WHEN kind <> 4 AND first_operand IS NOT NULL AND (first_base IS NULL OR first_operand < first_base) THEN 'operand before base' ELSE '' END error FROM heads)
SELECT j.store_id, j.k AS key, kind, base_seq, coalesce(operands, 0) AS operands, newest_seq,
  CASE WHEN error <> '' THEN 0 WHEN kind = 4 THEN 1 ELSE coalesce(cells, 0) END::BIGINT AS cells,
  CASE WHEN error = '' THEN md5(CASE WHEN kind = 4 THEN hex(newest) ELSE coalesce(body, '') END) END AS digest, error
FROM judged j LEFT JOIN states s ON s.store_id = j.store_id AND s.k = j.k LEFT JOIN behind b ON b.store_id = j.store_id AND b.k = j.k""",
    "sketch_catalog": f"""WITH {_EFF}
SELECT store_id, ('0x' || k[3:4])::INT AS kind, k[5:] AS name, count(*) AS operations, max(seq_id) AS last_seq, arg_max(op_type, seq_id) = 1 AS deleted
FROM eff WHERE k[1:2] = '01' AND length(k) >= 4 AND op_type IN (0, 1, 2) GROUP BY store_id, k""",
    "notify_point_events": f"""WITH {_EFF}, {_SUBS}
SELECT listener_id, CASE op_type WHEN 0 THEN 'PUT' ELSE 'DELETE' END AS type, count(*) AS events, min(k) AS first_key, max(k) AS last_key
FROM eff JOIN hexsubs ON (lo = '' OR lo <= k) AND (up = '' OR up >= k) WHERE op_type IN (0, 1) GROUP BY listener_id, op_type""",
    "notify_range_events": f"""WITH {_EFF}, {_SUBS}
SELECT listener_id, 'RANGEDEL' AS type, count(*) AS events, min(k) AS first_key, max(v) AS last_key
FROM eff JOIN hexsubs ON (lo = '' OR lo <= v) AND (up = '' OR up >= k) WHERE op_type = 3 AND k <= v GROUP BY listener_id""",
    "token_bucket_admission": """
WITH RECURSIVE calls AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) rn FROM events),
fold AS (
  SELECT user_id, event_id, at_ms, rn, 2 AS tokens, at_ms AS refilled, true AS admitted FROM calls WHERE rn = 1
  UNION ALL
  SELECT c.user_id, c.event_id, c.at_ms, c.rn,
    CASE WHEN c.at_ms - f.refilled >= 86400000 THEN 2 ELSE greatest(f.tokens - 1, 0) END,
    CASE WHEN c.at_ms - f.refilled >= 86400000 THEN c.at_ms ELSE f.refilled END,
    c.at_ms - f.refilled >= 86400000 OR f.tokens > 0
  FROM fold f JOIN calls c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT user_id::VARCHAR AS bucket, event_id AS call_id, at_ms, admitted FROM fold""",
    "backup_incremental_files": f"""WITH RECURSIVE {_BACKUPS}
SELECT store_id, id, file FROM own o WHERE NOT EXISTS (
  SELECT 1 FROM lineage l JOIN own p ON p.store_id = l.store_id AND p.id = l.ancestor WHERE l.id <> l.ancestor AND l.store_id = o.store_id AND l.id = o.id AND p.file = o.file)""",
    "backup_restore_set": f"""WITH RECURSIVE {_BACKUPS}
SELECT l.store_id, l.id, o.file, arg_max(l.ancestor, (p.ts, l.ancestor)) AS from_id FROM lineage l
JOIN own o ON o.store_id = l.store_id AND o.id = l.ancestor JOIN b p ON p.store_id = l.store_id AND p.id = l.ancestor GROUP BY l.store_id, l.id, o.file""",
    "backup_cascade_closure": f"WITH RECURSIVE {_BACKUPS} SELECT store_id, ancestor AS id, id AS dependent FROM lineage WHERE id <> ancestor",
}
