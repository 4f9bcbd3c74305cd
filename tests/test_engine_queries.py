"""Registered queries do the whole job."""

import os

import duckdb
import pytest

from siltbed.operators import scan
from siltbed.plans import engine_queries
from siltbed.plans.engine_sql import SQL

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in os.listdir(ROOT):
        connection.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return connection


@pytest.mark.parametrize("name", ["range_scan_page", "prefix_scan_page", "snapshot_versions", "page_dirty"])
def test_queries_of_every_store(spark, db, name):
    want = db.sql(SQL[name])
    columns = want.columns
    got = sorted(tuple(r[c] for c in columns) for r in engine_queries.QUERIES[name](spark, ROOT).collect())
    assert got == sorted(want.fetchall()) and len({g[columns.index("store_id")] for g in got}) > 1


LOG = "store_id int, seq_id long, op_type byte, key binary, value binary, expires_at_ms long"


def test_range_deletes_make_pages_dirty(spark):
    """Pages a-b, c-d, e-f, g-h, i-j: covered at its first key, begun within, touched by a put, beside and old ranges, begun and ended within."""
    puts = [(1, i, 0, k, b"v", None) for i, k in enumerate([b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h", b"i", b"j"], 1)]
    later = [(1, 21, 3, b"A", b"a", None), (1, 22, 3, b"d", b"d", None), (1, 23, 0, b"e", b"w", None), (1, 24, 3, b"h\x00", b"h\xff", None), (1, 25, 3, b"i\x00", b"i\xff", None), (1, 26, 3, b"z", b"a", None)]
    old = [(1, 15, 3, b"g\x00", b"g\xff", None), (2, 1, 0, b"a", b"v", None), (2, 2, 0, b"b", b"v", None)]
    pages = scan.dirty_pages(spark.createDataFrame(puts + later + old, LOG), 20, 2).collect()
    got = {(r.store_id, r.page): (r.changed_keys, r.dirty) for r in pages}
    assert got == {(1, 0): (0, True), (1, 1): (0, True), (1, 2): (1, True), (1, 3): (0, False), (1, 4): (0, True), (2, 0): (0, False)}
