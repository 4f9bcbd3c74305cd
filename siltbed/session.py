"""Where intermediate tables are written, and sizes taken from the session."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltbed-")
        _drop_at_end(spark, _local_roots[context.applicationId])
    return _local_roots[context.applicationId]


def _own_folder(spark: SparkSession) -> str:
    app = f"{scratch_root(spark)}/siltbed/{spark.sparkContext.applicationId}"
    _drop_at_end(spark, app)
    return app


def scratch(spark: SparkSession, name: str) -> str:
    """A path not in use below scratch_root(), deleted when the application ends."""
    ship(spark)
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that it need not be installed there."""
    context, package = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_own_folder(spark)}/siltbed.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)


def _drop_at_end(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)


def settle(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df written to path and read again: a cut lineage that survives the loss of executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to send it to all executors if it has at most so many rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
