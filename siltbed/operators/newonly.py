"""Processing only what is new or changed: Merkle trees over key ranges of items.

An item is (kind, store_id, item_id, version). Items are cut into leaves by ranges of item_id;
a leaf's digest covers its items in any order, a node's digest those of its children. The
tree that the last good run saved is compared with the present one from the root down: only children of
differing nodes are looked at, and only the items of differing leaves are compared one by one with
the saved ones. The output is then published with the new tree and items under one version
number: the marker file written last makes all of it count, so a run that dies leaves nothing
behind that a later one would read, and a run repeated after that gives the same output.

Where no tree was saved, the state is rebuilt from the history of runs (`flushed`, `backed_up`).

Nulls: an item without store, number or version is none. Copies of an item are one: of several
versions the earliest counts for log records (first arrival), the latest for files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions.columns import epoch_seconds, is_word, last_component, micros
from siltbed.session import settle

#: Items numbers a leaf spans, and children of a node (a power of two).
LEAF, FAN = 4096, 16
ITEM = ["kind", "store_id", "item_id", "version"]


def digest_leaves(items: DataFrame) -> DataFrame:
    """kind, store_id, leaf, digest of items with a column leaf."""
    h = F.xxhash64(*ITEM)
    whole = F.concat_ws("-", F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))
    return items.groupBy("kind", "store_id", "leaf").agg(F.md5(whole.cast("binary")).alias("digest"))


def tree(items: DataFrame, keep_at: str) -> DataFrame:
    """All nodes: level (0 the leaves), kind, store_id, node, digest. One root a kind and store, at the level where one node is left for all."""
    leaves = settle(digest_leaves(items).select(F.lit(0).alias("level"), "kind", "store_id", F.col("leaf").alias("node"), "digest"), f"{keep_at}/0")
    top = leaves.agg(F.max("node")).first()[0] or 0
    levels, level = [leaves], 0
    while top > 0:
        # A node has FAN children at most, so their list is short.
        parents = levels[-1].groupBy("kind", "store_id", F.floor(F.col("node") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("children"))
        joined = F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["node"], c["digest"])))
        level, top = level + 1, top // FAN
        levels.append(parents.select(F.lit(level).alias("level"), "kind", "store_id", "node", F.md5(joined.cast("binary")).alias("digest")))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return settle(nodes, f"{keep_at}/nodes")


def changed_leaves(saved: DataFrame, present: DataFrame) -> DataFrame:
    """kind, store_id, leaf of the leaves that differ or exist in present only, found from the roots down."""
    at = ["kind", "store_id", "node"]
    top = present.agg(F.max("level")).first()[0]
    if top is None:
        return present.select("kind", "store_id", F.col("node").alias("leaf"))
    saved_top = saved.agg(F.max("level")).first()[0]
    open_nodes = None
    for level in range(top, -1, -1):
        mine = present.where(F.col("level") == level).select(*at, "digest")
        if open_nodes is not None:
            mine = mine.withColumn("up", F.floor(F.col("node") / FAN)).join(open_nodes.withColumnRenamed("node", "up"), ["kind", "store_id", "up"], "left_semi").select(*at, "digest")
        if saved_top is not None and level <= saved_top:
            known = saved.where(F.col("level") == level).select(*at, F.col("digest").alias("saved_digest"))
            mine = mine.join(known, at, "left").where("saved_digest is null or saved_digest != digest")
        open_nodes = mine.select(*at)
    return open_nodes.withColumnRenamed("node", "leaf")


@dataclass
class Tracker:
    """Versions of saved items, tree and output below one folder."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        return jvm, fs, root

    def version(self) -> int:
        """The last published version; 0 if there is none."""
        jvm, fs, root = self._fs()
        return max([0, *(int(s.getPath().getName()) for s in fs.listStatus(root))])

    def _folder(self, version: int) -> str:
        """A folder for a version not yet published; what an earlier, unpublished attempt left there goes."""
        jvm, fs, root = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{version}"), True)
        return f"{self.path}/{version}"

    def _publish(self, version: int) -> None:
        jvm, fs, root = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(root, str(version)), False).close()

    @staticmethod
    def _kept(items: DataFrame, unique: bool, to: str) -> DataFrame:
        rows = items.select(*ITEM).where(" and ".join(f"{c} is not null" for c in ITEM))
        return settle((rows if unique else rows.distinct()).withColumn("leaf", F.floor(F.col("item_id") / LEAF)), f"{to}/items")

    def restore(self, items: DataFrame, unique: bool = False) -> None:
        """Publish what history says is done as a version of its own, without output."""
        version = self.version() + 1
        to = self._folder(version)
        kept = self._kept(items, unique, to)
        tree(kept, f"{to}/tree")
        self._publish(version)

    def run(self, items: DataFrame, unique: bool = False) -> DataFrame:
        """Find, publish and return the items (kind, store_id, item_id, version) that are new or changed since the last version.

        unique: no item comes twice, as from log_items() and file_items(), so no copies are looked for.
        """
        last = self.version()
        to = self._folder(last + 1)
        kept = self._kept(items, unique, to)
        nodes, new = tree(kept, f"{to}/tree"), kept
        if last:
            read = self.spark.read
            leaves = settle(changed_leaves(read.parquet(f"{self.path}/{last}/tree/nodes"), nodes), f"{to}/changed")
            known = read.schema(kept.schema).parquet(f"{self.path}/{last}/items")
            at = ["kind", "store_id", "leaf"]
            new = kept.join(leaves, at, "left_semi").join(known.join(leaves, at, "left_semi"), [*at, "item_id", "version"], "left_anti")
        out = settle(new.select(*ITEM), f"{to}/output")
        self._publish(last + 1)
        return out


def log_items(oplog: DataFrame) -> DataFrame:
    """Items of the log: each distinct record with its earliest arrival as version."""
    rows = oplog.where("rec_type in (0, 2) and store_id is not null and seq_id is not null")
    first = rows.groupBy("store_id", F.col("seq_id").alias("item_id")).agg(F.min("arrived_at").alias("first"))
    return first.select(F.lit("record").alias("kind"), "store_id", "item_id", F.coalesce(micros(F.col("first")), F.lit(2**63 - 1)).alias("version"))


def file_items(store_files: DataFrame) -> DataFrame:
    """Items of the data folder: each file that is there, with its last change as version, and its name."""
    rows = store_files.where("dir = 'data' and deleted_at is null and store_id is not null and file_id is not null")
    each = rows.groupBy("store_id", F.col("file_id").alias("item_id")).agg(F.max("modified_at").alias("changed"), F.max("file_name").alias("file_name"))
    return each.select(F.lit("file").alias("kind"), "store_id", "item_id", F.coalesce(micros(F.col("changed")), F.lit(2**63 - 1)).alias("version"), "file_name")


def flushed(items: DataFrame, runs: DataFrame) -> DataFrame:
    """The log items that a successful run has covered: its watermark is at or above the number and it started at or after the arrival.

    For a number n only the latest start among runs with a watermark of n or more matters. Runs are
    reduced to one per watermark and grouped by leaf; a leaf carries the latest start of all
    higher leaves, and compares its own watermarks (one a number at most) item by item.
    """
    good = runs.where(is_word(F.col("status"), "ok") & F.col("flushed_up_to_seq_id").isNotNull() & F.col("store_id").isNotNull())
    marks = good.groupBy("store_id", F.col("flushed_up_to_seq_id").alias("mark")).agg(F.max(micros(F.col("started_at"))).alias("start"))
    marks = marks.withColumn("leaf", F.floor(F.col("mark") / LEAF))
    own = marks.groupBy("store_id", "leaf").agg(F.max("start").alias("latest"), F.collect_list(F.struct("mark", "start")).alias("marks"))
    placed = items.select(*ITEM).withColumn("leaf", F.floor(F.col("item_id") / LEAF))
    leaves = placed.select("store_id", "leaf").distinct().join(own, ["store_id", "leaf"], "full")
    above = Window.partitionBy("store_id").orderBy(F.col("leaf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("above", F.max("latest").over(above)).select("store_id", "leaf", "above", "marks")
    inside = F.array_max(F.transform(F.filter("marks", lambda m: m["mark"] >= F.col("item_id")), lambda m: m["start"]))
    start = F.greatest(F.col("above"), inside)
    return placed.join(leaves, ["store_id", "leaf"]).where(start >= F.col("version")).select(*ITEM)


def backed_up(files: DataFrame, backups: DataFrame) -> DataFrame:
    """The file items (with file_name) that a complete backup holds as they are now."""
    good = backups.where(is_word(F.col("status"), "complete") & F.col("ts").isNotNull())
    names = good.select("store_id", micros(epoch_seconds(F.col("ts"))).alias("taken"), F.explode("new_files").alias("name"))
    latest = names.groupBy("store_id", last_component(F.col("name")).alias("file_name")).agg(F.max("taken").alias("taken"))
    return files.select(*ITEM, "file_name").join(latest, ["store_id", "file_name"]).where("taken >= version").select(*ITEM)
