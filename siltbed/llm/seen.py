"""Has this key been seen before? Log-structured sorted runs of key hashes on disk.

Deliveries are taken in consecutive batches. A run is an immutable table of the keys first seen in a
batch: it lies in hash buckets (the fences, as many as the session has shuffle partitions) and is
sorted by hash inside, so row groups' statistics fence the blocks. A batch is reduced to its distinct keys, which probe
all runs by merge joins; a run is read as it lies, and only the batch's keys are exchanged and sorted. The hash finds, the full
key decides. What the probe finds new is the next run, and every delivery of the batch that isn't the
first of such a key is decided as seen. When a level has as many runs as the fan-out, they are merged into one
of the next level, by a merge join again. No set of keys is held in memory, and a hot key costs one row a task.

Batches are whole tables here, so each of them has keys in every block, and no block is skipped;
a batch smaller than the number of blocks would skip by the statistics.

Nulls: a row without group, key or delivery number is neither seen nor does it make a key
seen. Rows that share a delivery number don't precede each other.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.session import scratch, settle, shuffle_partitions

#: Batches that a history is cut into at least, deliveries of a batch at most, runs of a level before they are merged, bits of the hash whose errors are reported.
BATCHES, BATCH_ROWS, FAN_OUT, REPORT_BITS = 4, 2_000_000_000, 2, 16
#: Spark reads the order of a bucketed table's files only with this setting.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def key_hash(bits: int = 64) -> Column:
    """A hash of group and key; of fewer bits (a multiple of four), the beginning of the key's MD5."""
    return F.xxhash64("grp", "key") if bits == 64 else F.conv(F.substring(F.md5("key"), 1, bits // 4), 16, 10).cast("long")


@contextmanager
def _sorted_tables(spark: SparkSession):
    was = spark.conf.get(_ORDERED, "false")
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, was)


@dataclass
class Runs:
    """Levels of immutable runs below one folder. With verify hits are decided by the full key, else by group and hash."""

    spark: SparkSession
    path: str
    bits: int = 64
    verify: bool = True
    fan_out: int = FAN_OUT
    levels: list[list[str]] = field(default_factory=lambda: [[]])
    tables: list[str] = field(default_factory=list)
    buckets: int = 0

    def __post_init__(self):
        self.buckets = self.buckets or shuffle_partitions(self.spark)
        self.identity = ["h", "grp", "key"] if self.verify else ["h", "grp"]

    def _write(self, keys: DataFrame) -> str:
        name = f"siltbed_run_{uuid.uuid4().hex[:16]}"
        keys.select(*self.identity, "first_id").write.format("parquet").bucketBy(self.buckets, *self.identity).sortBy(*self.identity).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def read(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def drop(self) -> None:
        """Take the runs out of the catalog; their files go with the folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def compact(self) -> None:
        """Merge each level that has too many runs, lowest first; keys of different runs differ, so a full merge join is their union in order."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fan_out:
                merged = self.spark.table(self.levels[k][0])
                for name in self.levels[k][1:]:
                    other = self.spark.table(name).select(*self.identity, F.col("first_id").alias("other_id")).hint("merge")
                    merged = merged.join(other, self.identity, "full").select(*self.identity, F.coalesce("first_id", "other_id").alias("first_id"))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                self.levels[k] = []
            k += 1

    def probe(self, batch: DataFrame) -> DataFrame:
        """Distinct keys of a batch (grp, key, delivery_id) with the first delivery, and seen: whether a run has them."""
        # Outer joins, as anti joins would be moved below the aggregate, where every delivery of a hot key takes part.
        keys = batch.withColumn("h", key_hash(self.bits)).groupBy(*self.identity).agg(F.min("delivery_id").alias("first_id"))
        keys = keys.withColumn("seen", F.lit(False))
        for run in self.read():
            known = run.select(*self.identity, F.lit(True).alias("hit")).hint("merge")
            keys = keys.join(known, self.identity, "left").select(*self.identity, "first_id", (F.col("seen") | F.col("hit").isNotNull()).alias("seen"))
        return keys

    def add(self, batch: DataFrame) -> DataFrame:
        """Decide a batch, whose deliveries are later than all before: adds the run of its new keys, returns their firsts (grp, h, first_id)."""
        with _sorted_tables(self.spark):
            self.compact()
            run = self._write(self.probe(batch).where("not seen"))
        self.levels[0].append(run)
        return self.spark.table(run).select("grp", "h", "first_id")


def _known(rows: DataFrame) -> DataFrame:
    return rows.select("grp", "key", "delivery_id").where("grp is not null and key is not null and delivery_id is not null")


def _batches(rows: DataFrame, batches: int) -> list[DataFrame]:
    span = rows.agg(F.min("delivery_id").alias("lo"), F.max("delivery_id").alias("hi"), F.count("*").alias("n")).first()
    batches = max(batches, -(-span.n // BATCH_ROWS))
    lo, hi = span.lo or 0, (span.hi or 0) + 1
    cuts = sorted({lo + (hi - lo) * k // batches for k in range(batches)} | {hi})
    return [rows.where((F.col("delivery_id") >= since) & (F.col("delivery_id") < till)) for since, till in zip(cuts, cuts[1:])]


def index_deliveries(rows: DataFrame, batches: int = BATCHES, bits: int = 64, verify: bool = True) -> Runs:
    """Runs with the first delivery of every key of rows (grp int, key, delivery_id), taken in that many batches."""
    rows = _known(rows)
    runs = Runs(rows.sparkSession, scratch(rows.sparkSession, "seen"), bits, verify)
    for batch in _batches(rows, batches):
        runs.add(batch)
    return runs


def seen_before(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """delivery_id of each row (grp int, key, delivery_id) whose key its group has had at a smaller delivery_id."""
    spark, rows = rows.sparkSession, _known(rows)
    runs, out = Runs(spark, scratch(spark, "seen")), None
    for n, batch in enumerate(_batches(rows, batches)):
        new = runs.add(batch).select("h", F.col("first_id").alias("delivery_id"))
        # The hash keeps rows apart that share a delivery number against the rule.
        decided = batch.select("delivery_id", key_hash().alias("h")).join(new, ["delivery_id", "h"], "left_anti").select("delivery_id")
        decided = settle(decided, f"{runs.path}/decided-{n}")
        out = decided if out is None else out.unionByName(decided)
    runs.drop()
    return out


def firsts(runs: Runs) -> DataFrame:
    """grp, h, first_id of every key: the deliveries that were decided as new."""
    every = [run.select("grp", "h", "first_id") for run in runs.read()]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def error_rate(rows: DataFrame, batches: int = BATCHES, bits: int = REPORT_BITS) -> DataFrame:
    """Per group: decisions, rows seen before, and the decisions that were wrong, in two indexes.

    wrong: decisions of the index that compares full keys; wrong_by_hash and rate_by_hash: those of an
    index that keeps nothing of a key but a hash of so many bits. Both are run, and what each
    decided as new is compared with the true first delivery of every key.
    """
    rows = _known(rows)
    spark = rows.sparkSession
    exact, short = index_deliveries(rows, batches), index_deliveries(rows, batches, bits, verify=False)
    truth = settle(rows.groupBy("grp", "key").agg(F.min("delivery_id").alias("first_id")).select("grp", key_hash().alias("h"), "first_id"), scratch(spark, "truth"))
    off = truth.withColumn("t", F.lit(1)).join(firsts(exact).withColumn("d", F.lit(1)), ["grp", "h", "first_id"], "full").where("t is null or d is null").groupBy("grp").agg(F.count("*").alias("wrong"))
    missed = truth.join(firsts(short).select("grp", "first_id"), ["grp", "first_id"], "left_anti").groupBy("grp").agg(F.count("*").alias("wrong_by_hash"))
    total = rows.groupBy("grp").agg(F.count("*").alias("decisions"))
    new = firsts(exact).groupBy("grp").agg(F.count("*").alias("new_keys"))
    out = total.join(new, "grp").join(off, "grp", "left").join(missed, "grp", "left").na.fill(0, ["wrong", "wrong_by_hash"])
    out = out.select(
        "grp", "decisions", (F.col("decisions") - F.col("new_keys")).alias("seen"), "wrong_by_hash",
        "wrong", (F.col("wrong_by_hash") / F.col("decisions")).alias("rate_by_hash"),
    )
    out = settle(out, scratch(spark, "rates"))  # a row a group
    exact.drop()
    short.drop()
    return out
