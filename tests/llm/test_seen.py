"""Seen keys against plain Python, the levels of runs, and the plan of a probe."""

import random
import re

import pytest

from siltbed.llm import seen
from siltbed.session import scratch

ROWS = "grp int, key binary, delivery_id long, h int, seen string"


def some_rows():
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 2, None]), rnd.choice([b"hot", b"hot", b"", b"\x00", None, bytes([rnd.randrange(40)])]), rnd.choice([i, i, i, None]), 9, "y") for i in range(300)]
    return rows + rows[:9] + [(1, b"long" * 5000, 400, 9, "y"), (1, b"long" * 5000, 401, 9, "y")]


@pytest.mark.parametrize("batches", [1, 7])
def test_seen(spark, batches):
    rows = some_rows()
    known = [r for r in rows if None not in r[:3]]
    want = sorted(d for g, k, d, *_ in known if any(g == g2 and k == k2 and d2 < d for g2, k2, d2, *_ in known))
    assert sorted(r.delivery_id for r in seen.seen_before(spark.createDataFrame(rows, ROWS), batches).collect()) == want


def test_error_rates_are_measured(spark):
    rows = sorted(set(r[:3] for r in some_rows() if None not in r[:3]), key=lambda r: r[2])
    import hashlib

    report = {r.grp: r for r in seen.error_rate(spark.createDataFrame(rows, "grp int, key binary, delivery_id long"), 3, bits=4).collect()}
    for g in (1, 2):
        keys, hashes, wrong = set(), set(), 0
        for grp, key, _ in rows:
            if grp == g:
                h = hashlib.md5(key).hexdigest()[:1]
                wrong += key not in keys and h in hashes
                keys.add(key)
                hashes.add(h)
        n = sum(r[0] == g for r in rows)
        assert (report[g].decisions, report[g].seen, report[g].wrong, report[g].wrong_by_hash) == (n, n - len(keys), 0, wrong) and wrong > 0


def test_levels_and_empty(spark):
    rows = spark.createDataFrame([(1, bytes([i % 50]), i) for i in range(200)], "grp int, key binary, delivery_id long")
    runs = seen.index_deliveries(rows, batches=6)
    assert len(runs.levels) > 1 and all(len(level) <= runs.fan_out for level in runs.levels)
    assert sum(r.count() for r in runs.read()) == 50
    runs.drop()
    assert seen.seen_before(rows.limit(0)).count() == 0 and seen.error_rate(rows.limit(0)).count() == 0


def test_a_probe_reads_runs_as_they_lie(spark):
    """One exchange and one sort, both of the batch; none of a run."""
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(id % 3 as int) as grp", "cast(cast(id as string) as binary) as key", "id as delivery_id")
    runs = seen.Runs(spark, scratch(spark, "runs"), fan_out=9)
    for k in range(3):
        runs.add(rows(k * 100, k * 100 + 150))
    with seen._sorted_tables(spark):
        plan = runs.probe(rows(300, 600))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Bucketed: true", plan)) == 3 and len(re.findall("SortMergeJoin", plan)) == 3
    assert len(re.findall(r"Exchange ", plan)) == 1 and len(re.findall(r"\bSort ", plan)) == 1
    merged = runs.spark.table(runs.tables[0])
    assert merged.count() == 150 and sum(r.count() for r in runs.read()) == 350
    runs.drop()
