"""Planning compactions from the manifest, and what a merge of files holds.

Nulls: entries without store, layer or name list nothing; records without store, key or sequence id are none; copies are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.columns import DEL, RANGEDEL, is_reserved
from siltbed.operators import folds, history
from siltbed.operators.resolve import newest, not_expired, tombstones, with_cover
from siltbed.operators.smallfiles import listed_records, listing


def flush_plan(effective: DataFrame, rows_per_file: int) -> DataFrame:
    """Files a flush writes: stretches of the sequence of each store, with their bounds and counts."""
    each = effective.where("op_type in (0, 1, 2) and seq_id is not null").select("store_id", "seq_id", "op_type", "key").dropDuplicates(["store_id", "seq_id", "op_type", "key"])
    return each.groupBy("store_id", F.floor((F.col("seq_id") - 1) / rows_per_file).alias("file_no")).agg(
        F.count("*").alias("records"), F.count_if(F.col("op_type") == DEL).alias("deletes"),
        F.hex(F.min("key")).alias("min_key"), F.hex(F.max("key")).alias("max_key"), F.min("seq_id").alias("min_seq"), F.max("seq_id").alias("max_seq"),
    )


def file_metadata(records: DataFrame) -> DataFrame:
    return records.groupBy("store_id", "file_name").agg(
        F.count("*").alias("records"), F.countDistinct("seq_id").alias("distinct_records"), F.count_if(F.col("op_type") == DEL).alias("deletes"),
        F.hex(F.min("key")).alias("min_key"), F.hex(F.max("key")).alias("max_key"), F.min("seq_id").alias("min_seq"), F.max("seq_id").alias("max_seq"),
    )


def listed(manifest: DataFrame) -> DataFrame:
    """The files listed now with their key bounds, entered again counts once: store_id, layer, file_name, size_bytes, min_key, max_key."""
    name = F.substring_index("base_file_name", "/", -1)
    now = manifest.where("removed_at is null and store_id is not null and layer is not null and trim(base_file_name) != ''")
    return now.groupBy("store_id", "layer", name.alias("file_name")).agg(F.max("size_bytes").alias("size_bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def leveled_plan(manifest: DataFrame, files_at_0: int = 4) -> DataFrame:
    """Per store whose layer 0 has enough files: these and the files of layer 1 that overlap their key range."""
    files = listed(manifest)
    first = files.where("layer = 0").groupBy("store_id").agg(F.count("*").alias("inputs"), F.min("min_key").alias("lo"), F.max("max_key").alias("hi"), F.sum("size_bytes").alias("bytes"))
    first = first.where(F.col("inputs") >= files_at_0)
    below = files.where("layer = 1").select("store_id", F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"), F.col("size_bytes").alias("b_bytes"))
    hit = first.join(below, "store_id", "left")
    over = ~((F.col("b_hi") < F.col("lo")) | (F.col("b_lo") > F.col("hi")))
    return hit.groupBy("store_id", "inputs", "bytes").agg(F.count_if(over).alias("overlapping"), F.coalesce(F.sum(F.when(over, F.col("b_bytes"))), F.lit(0)).alias("overlapping_bytes"))


def overflow_plan(manifest: DataFrame, first_limit: int, factor: int) -> DataFrame:
    """Layers from 1 on whose files exceed first_limit * factor**(layer - 1) bytes, with the step that relieves them.

    The first file by name goes to the next layer: merged with the files there that overlap it, or
    moved, which changes the manifest only, where none does. The last layer merges into itself.
    """
    files = listed(manifest)
    last = files.groupBy("store_id").agg(F.max("layer").alias("last_layer"))
    tiers = files.where("layer >= 1").groupBy("store_id", "layer").agg(F.sum("size_bytes").alias("bytes"), F.min_by(F.struct("file_name", "min_key", "max_key"), "file_name").alias("f"))
    full = tiers.withColumn("limit", (F.lit(first_limit) * F.pow(F.lit(factor), F.col("layer") - 1)).cast("long")).where("bytes >= limit").join(last, "store_id")
    below = files.select("store_id", (F.col("layer") - 1).alias("layer"), F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"))
    over = ~((F.col("b_hi") < F.col("f.min_key")) | (F.col("b_lo") > F.col("f.max_key")))
    hit = full.join(below, ["store_id", "layer"], "left").groupBy("store_id", "layer", "bytes", "limit", "last_layer", "f.file_name").agg(F.count_if(over).alias("overlapping"))
    act = F.when(F.col("layer") == F.col("last_layer"), "merge in place").when(F.col("overlapping") == 0, "move").otherwise("merge")
    return hit.select("store_id", "layer", "bytes", "limit", "file_name", "overlapping", act.alias("action"))


def size_tiered_plan(manifest: DataFrame, threshold: int = 4) -> DataFrame:
    """Layers with enough files to merge into the next one; the last layer merges into itself."""
    files = listed(manifest)
    last = files.groupBy("store_id").agg(F.max("layer").alias("last_layer"))
    tiers = files.groupBy("store_id", "layer").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).where(F.col("files") >= threshold)
    to = F.when(F.col("layer") == F.col("last_layer"), F.col("layer")).otherwise(F.col("layer") + 1)
    return tiers.join(last, "store_id").select("store_id", "layer", "files", "bytes", to.alias("to_layer"), (F.col("layer") == F.col("last_layer")).alias("drops_tombstones"))


def surviving(ranges: DataFrame) -> DataFrame:
    """Range deletes (store_id, start_key, end_key, seq_id) that are the newest somewhere in their span; the others decide nothing."""
    from siltbed.operators.resolve import fragments

    ranges = ranges.groupBy("store_id", "start_key", "end_key").agg(F.max("seq_id").alias("seq_id"))
    pieces = fragments(ranges).select("store_id", "seq_id", F.col("start_key").alias("at"))
    # A sequence id belongs to one range delete, or to very few.
    return ranges.join(pieces, ["store_id", "seq_id"]).where("at between start_key and end_key").select("store_id", "start_key", "end_key", "seq_id").distinct()


def merge_records(rows: DataFrame, drop_tombstones: bool, now_ms: int | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """What remains of records in one merge: store_id, key, seq_id, op_type, value, expires_at_ms.

    The newest version of each user key, and for the keys of snapshots (store_id, key, since_seq) also the
    versions these keep; keys under a newer range delete go; sketches are folded (folds.compacted()).
    With drop_tombstones, for merges that no older record can lie beneath, deletes and range deletes go. Else
    deletes stay, surviving range deletes stay (op RANGEDEL, value the inclusive end), and a newest version that has expired
    at now_ms becomes a delete, as each of them hides older versions in files that take no part. Range deletes also stay where snapshots keep versions.
    """
    columns = ["store_id", "key", "seq_id", "op_type", "value", "expires_at_ms"]
    user = rows.where(~is_reserved(F.col("key")))
    ranges = tombstones(rows)
    kept = with_cover(newest(user), ranges).where("cover_seq is null").drop("cover_seq")
    if now_ms is not None:
        gone = ~not_expired(now_ms)
        kept = kept.select("store_id", "key", "seq_id", F.when(gone, F.lit(DEL)).otherwise(F.col("op_type")).cast("byte").alias("op_type"), F.when(~gone, F.col("value")).alias("value"), F.when(~gone, F.col("expires_at_ms")).alias("expires_at_ms"))
    if drop_tombstones:
        kept = kept.where(F.col("op_type") != DEL)
    out = kept.select(*columns)
    if snapshots is not None:
        held = history.kept_by_snapshots(user, snapshots)
        if now_ms is not None:
            held = held.where(not_expired(now_ms))
        out = out.unionByName(held.select(*columns)).dropDuplicates(["store_id", "key", "seq_id", "op_type"])
    sketches = folds.compacted(rows, keep_deletes=not drop_tombstones).withColumn("expires_at_ms", F.lit(None).cast("long"))
    out = out.withColumn("op_type", F.col("op_type").cast("byte")).unionByName(sketches.select(*columns))
    if not drop_tombstones or snapshots is not None:
        left = surviving(ranges).select("store_id", F.col("start_key").alias("key"), "seq_id", F.lit(RANGEDEL).cast("byte").alias("op_type"), F.col("end_key").alias("value"), F.lit(None).cast("long").alias("expires_at_ms"))
        out = out.unionByName(left)
    return out


def merged(records: DataFrame, manifest: DataFrame, layers: list[int] | None = None, drop_tombstones: bool = True, now_ms: int | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """merge_records() of the listed files of some layers, all by default."""
    files = listing(manifest)
    if layers is not None:
        files = files.where(F.col("layer").isin(layers))
    return merge_records(listed_records(records, files.select("store_id", "layer", "file_name")), drop_tombstones, now_ms, snapshots)


def rest(records: DataFrame, manifest: DataFrame, layers: list[int]) -> DataFrame:
    """The records of listed files of all other layers."""
    return listed_records(records, listing(manifest).where(~F.col("layer").isin(layers)).select("store_id", "layer", "file_name"))
