"""Rewriting many tiny files of a partition into few well-sized ones.

A compacted table is a folder of Parquet files by version, store and layer, and a log of
snapshots beside it. A run takes the partitions (store, layer) that list more small files than
allowed, and rewrites only these, by dynamic partition overwrite: records come in order of
their key, in files of about the wanted size, each record once. Partitions with few files stay
as they are.

The version is the outermost partition column and is new in every attempt, so an overwrite
never touches files that a reader may have. A snapshot maps each rewritten partition to its
version and to a fingerprint of the listing it was made from. A run notes the snapshot it started from,
writes, compares the fingerprints of the listing again, and only then publishes the next snapshot, by
creating its file, which fails if it is there. On any difference it gives up with Conflict; what it wrote
belongs to no snapshot, and vacuum() deletes it. Readers take one snapshot and see it to the end.

A claim keeps two runs from doing the same work. It names its owner and time and is void after
LEASE_MS, so that the claim of a dead run is taken over.

Nulls: an entry without store, layer or name lists nothing; a record without sequence id is
none. Records of one partition with equal key and sequence id are one. A column "layer" of the records is
replaced by the layer of the listing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.session import bounded_broadcast, settle

PART = ["store_id", "layer"]
#: A file below this size is small; a partition may list so many of them; wanted bytes of input a new file.
SMALL_BYTES, SMALL_FILES, FILE_BYTES = 1 << 20, 8, 64 << 20
#: A listing of at most so many names (under 100 bytes each) is sent to the executors; a longer one is joined by merging.
BROADCAST_NAMES = 50_000
#: Bytes of a record besides its key and value.
OVERHEAD = 24
#: Codec of the new files.
CODEC = "zstd"
#: Milliseconds after which a claim is void.
LEASE_MS = 6 * 3_600_000

_MAP = "store_id int, layer int, digest string, version string"


class Conflict(RuntimeError):
    """Another run published a snapshot or has claimed one, or a listing changed, since this one began."""


def listing(manifest: DataFrame) -> DataFrame:
    """The files listed now: store_id, layer, file_name, size_bytes; entered again counts once."""
    name = F.substring_index("base_file_name", "/", -1)
    now = manifest.where("removed_at is null").select(*PART, name.alias("file_name"), "size_bytes")
    now = now.where("store_id is not null and layer is not null and trim(file_name) != ''")
    return now.groupBy(*PART, "file_name").agg(F.max("size_bytes").alias("size_bytes"))


def fingerprints(listed: DataFrame) -> DataFrame:
    """Per partition: files, small files, bytes, and a digest that changes with the listing."""
    digest = F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("file_name", "size_bytes")))
    return listed.groupBy(*PART).agg(
        F.count("*").alias("files"), F.count_if(F.coalesce(F.col("size_bytes"), F.lit(0)) < SMALL_BYTES).alias("small"),
        F.sum("size_bytes").alias("bytes"), digest.alias("digest"),
    )


def listed_records(records: DataFrame, listed: DataFrame) -> DataFrame:
    """Every record of a listed file with the layer of the listing; copies are still there."""
    names = bounded_broadcast(listed.select(*PART, "file_name"), BROADCAST_NAMES)
    return records.drop("layer").where("seq_id is not null").join(names, ["store_id", "file_name"])


def listed_bytes(records: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: bytes of the records of the listed files. They are summed by file before the listing is joined, so no record is exchanged for it."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("key", "value") if c in records.columns), F.lit(OVERHEAD))
    by_file = records.where("seq_id is not null").groupBy("store_id", "file_name").agg(F.sum(width).alias("bytes"))
    return by_file.join(listed.select(*PART, "file_name"), ["store_id", "file_name"]).agg(F.sum("bytes").alias("bytes"))


def _exists_already(e: Py4JJavaError) -> bool:
    return "FileAlreadyExists" in e.java_exception.getClass().getName()


@dataclass
class CompactedTable:
    spark: SparkSession
    path: str
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000)
    lease_ms: int = LEASE_MS

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        return jvm, fs, folder

    def _create(self, folder_name: str, name: str, content: dict) -> None:
        """A file that is created once; Conflict if it is there."""
        jvm, fs, folder = self._fs(folder_name)
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, name), False)
        except Py4JJavaError as e:
            if _exists_already(e):
                raise Conflict(f"{folder_name}/{name} is there already") from e
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _json(self, folder_name: str, name: str) -> dict | None:
        """Content of such a file; None if its writer died before it was whole."""
        jvm, fs, folder = self._fs(folder_name)
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def _numbers(self) -> list[int]:
        _, fs, folder = self._fs("_snapshots")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def snapshot(self) -> tuple[int, str | None]:
        """Number and map folder of the last whole snapshot; 0 and None at first."""
        for number in reversed(self._numbers()):
            if found := self._json("_snapshots", str(number)):
                return number, found["map"]
        return 0, None

    def partitions(self, at: str | None) -> DataFrame:
        """store_id, layer, digest, version of each partition of a snapshot's map."""
        return self.spark.createDataFrame([], _MAP) if at is None else self.spark.read.schema(_MAP).parquet(f"{self.path}/_maps/{at}")

    def _claim(self, number: int) -> str:
        """Claim a snapshot's number: the first free or void place in the row of its claims."""
        _, fs, folder = self._fs("_claims")
        mine = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith(f"{number}-")]
        last = max((int(n.split("-")[1]) for n in mine if n.split("-")[1].isdigit()), default=-1)
        if last >= 0:
            held = self._json("_claims", f"{number}-{last}")
            if held is None or held["until"] > self.now_ms():
                # A claim that is not whole yet counts from the time of its file.
                if held is not None or self.now_ms() - self._written("_claims", f"{number}-{last}") < self.lease_ms:
                    raise Conflict(f"snapshot {number} is claimed by {held['owner'] if held else 'another run'}")
        owner = uuid.uuid4().hex[:12]
        self._create("_claims", f"{number}-{last + 1}", {"owner": owner, "until": self.now_ms() + self.lease_ms})
        return f"{number}-{last + 1}"

    def _written(self, folder_name: str, name: str) -> int:
        jvm, fs, folder = self._fs(folder_name)
        return fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(folder, name)).getModificationTime()

    def _release(self, claim: str) -> None:
        jvm, fs, folder = self._fs("_claims")
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, claim), False)

    def compact(self, records: DataFrame, manifest: DataFrame, small_files: int = SMALL_FILES, file_bytes: int = FILE_BYTES, relist: Callable[[], DataFrame] | None = None) -> int:
        """Rewrite the partitions that list more than small_files small files; returns their number.

        relist reads the manifest anew for the check after the rewrite.
        """
        base, at = self.snapshot()
        version = f"{base + 1}-{uuid.uuid4().hex[:12]}"
        listed = listing(manifest)
        known = self.partitions(at)
        parts = settle(fingerprints(listed), f"{self.path}/_tmp/{version}/parts")
        mine = parts.where(F.col("small") > small_files).join(known.select(*PART, F.col("digest").alias("old")), PART, "left").where("old is null or old != digest")
        chosen = settle(mine.select(*PART, "digest", F.lit(version).alias("version")), f"{self.path}/_tmp/{version}/chosen")
        number = chosen.count()
        if not number:
            return 0
        claim = self._claim(base + 1)
        try:
            names = settle(listed.join(chosen, PART, "left_semi"), f"{self.path}/_tmp/{version}/names")
            rows = listed_records(records, names)
            # The manifest's sizes may be wrong, so the bytes are taken from the records.
            total = listed_bytes(records, names).first()["bytes"] or 0
            # As many ranges as all the bytes fill; small partitions share one.
            ranges = max(1, -(-total // file_bytes))
            columns = [c for c in records.columns if c not in (*PART, "file_name", "entry_no", "version")]
            # Copies have one key, so they meet in one range of it, where they are dropped without another exchange.
            spread = rows.select(*PART, *columns).repartitionByRange(ranges, *PART, "key", "seq_id")
            rest = [F.first(c).alias(c) for c in columns if c not in ("key", "seq_id")]
            once = spread.groupBy(*PART, "key", "seq_id").agg(*rest).sortWithinPartitions(*PART, "key", "seq_id")
            data = once.withColumn("version", F.lit(version))
            data.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy("version", *PART).parquet(f"{self.path}/data")
            after = fingerprints(listing(relist() if relist else manifest))
            moved = chosen.join(after.select(*PART, F.col("digest").alias("now")), PART, "left").where("now is null or now != digest")
            if gone := moved.limit(5).collect():
                raise Conflict(f"the listing changed in {', '.join(f'{r.store_id}/{r.layer}' for r in gone)}")
            # Partitions that list nothing any more leave the map.
            kept = known.join(chosen, PART, "left_anti").join(parts, PART, "left_semi")
            kept.unionByName(chosen).coalesce(1).write.parquet(f"{self.path}/_maps/{version}")
            if self.snapshot()[0] != base:
                raise Conflict("another run published a snapshot")
            self._create("_snapshots", str(max([base, *self._numbers()]) + 1), {"map": version, "base": base})
        finally:
            self._release(claim)
            self._delete(f"_tmp/{version}")
        return number

    def _delete(self, name: str) -> None:
        jvm, fs, folder = self._fs("_tmp")
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions and maps that none of the last snapshots uses and whose attempt is older than a lease; returns the versions."""
        jvm, fs, folder = self._fs("data")
        maps = [found["map"] for n in self._numbers() if (found := self._json("_snapshots", str(n)))][-keep:]
        used = {r.version for m in maps for r in self.partitions(m).select("version").distinct().toLocalIterator()}  # at most one a run
        old = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("version=") and name[8:] not in used and self.now_ms() - status.getModificationTime() > self.lease_ms:
                old.append(name[8:])
                fs.delete(status.getPath(), True)
        _, fs, folder = self._fs("_maps")
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in maps and self.now_ms() - status.getModificationTime() > self.lease_ms:
                fs.delete(status.getPath(), True)
        return sorted(old)

    def read(self, records: DataFrame, manifest: DataFrame) -> DataFrame:
        """All records by partition, each once: store_id, layer, key, seq_id; from the new files where they are current.

        The snapshot is taken now, so a run that publishes another one later changes nothing in this DataFrame.
        """
        _, at = self.snapshot()
        listed = listing(manifest)
        if at is None:
            return listed_records(records, listed).select(*PART, "key", "seq_id").distinct()
        current = self.partitions(at).join(fingerprints(listed).select(*PART, "digest"), [*PART, "digest"], "left_semi").select(*PART, "version")
        kind = {c: records.schema[c].dataType.simpleString() for c in ("key", "seq_id")}
        schema = ", ".join(f"{c} {k}" for c, k in kind.items()) + ", version string, " + ", ".join(f"{c} {listed.schema[c].dataType.simpleString()}" for c in PART)
        # Spark joins by broadcast where the map is below its threshold, which also prunes the folders.
        out = self.spark.read.schema(schema).parquet(f"{self.path}/data").join(current, ["version", *PART], "left_semi")
        rest = listed_records(records, listed.join(current, PART, "left_anti")).select(*PART, "key", "seq_id").distinct()
        return out.select(*PART, "key", "seq_id").unionByName(rest)
