"""Versioned tables for foreachBatch: one folder a batch, so a batch that is run again replaces its own output.

A version is made of whole tables and of keyed ones. A keyed table lies in hash buckets of its key, and a version
writes only the buckets that its batch touches; its marker, written last, says in which version each bucket lies.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a keyed table.
BUCKETS = 64


class Versions:
    """Tables below one folder; version n is what batch n left. A marker written last makes a version count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_done")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        return jvm, fs, root

    def _numbers(self) -> list[int]:
        _, fs, root = self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit())

    def before(self, batch: int) -> int | None:
        """The last version that counts and is older than the batch."""
        return max((n for n in self._numbers() if n < batch), default=None)

    def _marker(self, version: int) -> dict:
        jvm, fs, root = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, str(version)))
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        return json.loads(text)

    def read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}/{name}")

    def latest(self, name: str) -> DataFrame:
        return self.read(self.before(1 << 62), name)

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.hash(*keys), F.lit(self.buckets))

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """Buckets that rows fall into; at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(keys).alias("bucket")).distinct().collect())

    def keyed(self, version: int | None, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A keyed table as of a version, or some of its buckets."""
        out = self.spark.createDataFrame([], schema)
        if version is None:
            return out
        by_version: dict[int, list[int]] = {}
        for bucket, at in self._marker(version)["buckets"].get(name, {}).items():
            if buckets is None or int(bucket) in buckets:
                by_version.setdefault(at, []).append(int(bucket))
        for at, mine in sorted(by_version.items()):
            part = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{at}/{name}").where(F.col("bucket").isin(mine)).drop("bucket")
            out = out.unionByName(part)
        return out

    def write(self, version: int, keyed: dict[str, tuple[DataFrame, list[str], list[int]]] | None = None, extra: dict | None = None, **tables: DataFrame) -> None:
        """keyed: name to rows, key columns and the buckets that these rows replace. extra goes into the marker."""
        jvm, fs, root = self._fs()
        last = self.before(version)
        was = self._marker(last)["buckets"] if last is not None else {}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
        maps = dict(was)
        for name, (df, keys, buckets) in (keyed or {}).items():
            placed = df.withColumn("bucket", self.bucket(keys)).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{version}/{name}")
            maps[name] = was.get(name, {}) | {str(b): version for b in buckets}
        out = fs.create(jvm.org.apache.hadoop.fs.Path(root, str(version)), True)
        out.write(bytearray(json.dumps({"buckets": maps} | (extra or {})).encode()))
        out.close()

    def note(self, version: int | None, name: str):
        """What an earlier write put into its marker."""
        return None if version is None else self._marker(version).get(name)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete the folders that none of the last versions reads; returns their numbers."""
        jvm, fs, root = self._fs()
        last = self._numbers()[-keep:]
        used = set(last) | {at for v in last for m in self._marker(v)["buckets"].values() for at in m.values()}
        gone = [n for n in self._numbers() if n not in used]
        for n in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, str(n)), False)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return gone
