"""SHA-256 Merkle trees over the records of files: roots, proofs, and what differs.

An odd node is paired with itself. Nulls: a null value is hashed as "-"; a file without records has no tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.ordered import numbered
from siltbed.session import scratch, settle

FILE = ["store_id", "file_name"]
#: A block has 1 << BITS nodes.
BITS = 10


def leaves(records: DataFrame) -> DataFrame:
    """store_id, file_name, i, hash of every record, in the order of entry_no."""
    text = F.concat_ws("|", F.col("seq_id").cast("string"), F.col("op_type").cast("string"), F.hex("key"), F.coalesce(F.hex("value"), F.lit("-")))
    hashed = records.select(*FILE, "entry_no", F.sha2(text.cast("binary"), 256).alias("hash"))
    return numbered(hashed, FILE, [F.col("entry_no").asc()], "i").select(*FILE, "i", "hash")


def _pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def _above(level: Column) -> Column:
    """The next level of a list of hashes; an odd one at the end is paired with itself."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: _pair(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (file, i, hash) in blocks of 1024: file, block, rows, levels (lists of hashes from the block's nodes to its root).

    The only block of a file ends at its root; a block of a larger file goes up ten levels, whatever it holds, as its last node
    is paired with itself all the way. A first block that isn't full is its file's only one.
    """
    lists = nodes.groupBy(*FILE, F.shiftright("i", BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("rows"))
    steps = F.when((F.col("block") == 0) & (F.size("rows") < 1 << BITS), F.length(F.bin(F.size("rows") - 1)) - (F.size("rows") == 1).cast("int")).otherwise(BITS)
    lists = lists.select(*FILE, "block", F.transform("rows", lambda r: r["hash"]).alias("hashes"), steps.alias("steps"))
    up = F.aggregate(F.sequence(F.lit(0), F.col("steps")), F.array(F.col("hashes")), lambda acc, k: F.when(k == 0, acc).otherwise(F.concat(acc, F.array(_above(F.element_at(acc, -1))))))
    return lists.select(*FILE, "block", "steps", up.alias("levels"))


def _tops(blocks: DataFrame) -> DataFrame:
    """Roots of blocks as nodes: file, i, hash, steps."""
    return blocks.select(*FILE, F.col("block").alias("i"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), "steps")


def roots(leaf: DataFrame) -> DataFrame:
    """store_id, file_name, height, root. Ten levels are folded at once within a task, so a file of a million records takes two exchanges."""
    spark, found, nodes, height = leaf.sparkSession, None, leaf, 0
    while True:
        tops = settle(_tops(_blocks(nodes)), scratch(spark, "merkle"))
        last = tops.groupBy(*FILE).agg(F.max("i").alias("last"), F.max_by("hash", "i").alias("root"), F.max("steps").alias("steps"))
        done = last.where("last = 0").select(*FILE, (F.col("steps") + height).cast("int").alias("height"), "root")
        found = done if found is None else found.unionByName(done)
        if not tops.where("i > 0").limit(1).count():
            return found
        nodes, height = tops.join(last.where("last > 0").select(*FILE), FILE, "left_semi").select(*FILE, "i", "hash"), height + BITS


def proofs(leaf: DataFrame) -> DataFrame:
    """store_id, file_name, i, hash, siblings of every leaf: the hashes that lead from it to the root of its file."""
    blocks = settle(_blocks(leaf), scratch(leaf.sparkSession, "merkle"))
    near = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.col("steps")), lambda k: k < F.col("steps")), lambda k: _near(i, k))
    _near = lambda i, k: F.coalesce(F.get(F.get("levels", k), F.call_function("shiftright", i, k).bitwiseXOR(F.lit(1))), F.get(F.get("levels", k), F.call_function("shiftright", i, k)))
    own = F.get("levels", F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.struct(i.alias("at"), F.get(own, i).alias("hash"), near(i).alias("siblings")))
    low = blocks.select(*FILE, "block", F.explode(each).alias("e")).select(*FILE, "block", (F.col("block") * (1 << BITS) + F.col("e.at")).cast("long").alias("i"), "e.hash", "e.siblings")
    large = blocks.where("block > 0").select(*FILE).distinct()
    if not large.limit(1).count():
        return low.drop("block")
    high = proofs(_tops(blocks).join(large, FILE, "left_semi").select(*FILE, "i", "hash")).select(*FILE, F.col("i").alias("block"), F.col("siblings").alias("more"))
    both = low.join(high, [*FILE, "block"], "left")
    return both.select(*FILE, "i", "hash", F.concat("siblings", F.coalesce("more", F.array().cast("array<string>"))).alias("siblings"))


def proof(leaf: DataFrame, index: int) -> DataFrame:
    """The siblings from the given leaf of each file to its root: store_id, file_name, level, sibling."""
    return proofs(leaf).where(F.col("i") == index).select(*FILE, F.posexplode("siblings").alias("level", "sibling"))


def verified(proven: DataFrame, root: DataFrame) -> DataFrame:
    """Per file: leaves, and how many of their proofs lead to the file's root."""
    up = F.aggregate(
        F.arrays_zip(F.col("siblings").alias("s")), F.struct(F.col("hash").alias("h"), F.col("i").alias("i")),
        lambda acc, x: F.struct(F.when(acc["i"] % 2 == 1, _pair(x["s"], acc["h"])).otherwise(_pair(acc["h"], x["s"])).alias("h"), F.shiftright(acc["i"], 1).alias("i")),
    )
    each = proven.select(*FILE, up["h"].alias("reached")).join(root.select(*FILE, "root"), FILE)
    return each.groupBy(*FILE).agg(F.count("*").alias("leaves"), F.count_if(F.col("reached") == F.col("root")).alias("proven"))


def corrupted(saved: DataFrame, present: DataFrame) -> DataFrame:
    """Per file: whether all blocks agree, the number of those that don't (missing ones too), and the first."""
    both = saved.withColumnRenamed("hash", "saved").join(present, [*FILE, "i"], "full")
    bad = F.coalesce(F.col("saved") != F.col("hash"), F.lit(True))
    return both.groupBy(*FILE).agg((F.count_if(bad) == 0).alias("valid"), F.count_if(bad).alias("bad_blocks"), F.min(F.when(bad, F.col("i"))).alias("first_bad"))
