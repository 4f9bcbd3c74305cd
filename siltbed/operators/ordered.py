"""Numbering and carrying along an order, without one task for a whole group.

Rows are range-partitioned by group and order and written with the number of their partition.
What a partition needs from those before it (how many rows of its group, the last value) is
small, so a group of any size is spread over many tasks.

Nulls in the group are a group; nulls in the order come first. Ties in the order are
numbered in no stated order, so callers order by a unique key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import scratch, settle, ship


def _parted(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(g).asc() for g in group], *order).withColumn("_part", F.spark_partition_id())
    return settle(ranged, scratch(df.sparkSession, "ordered"))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """df with the number of each row within its group, from 0, as a long column.

    One exchange, by ranges of group and order: rows are numbered as they stream past in order, and only a group
    that goes on over the edge of a partition gets an offset, so what is broadcast is a row a partition at most.
    """
    spark, at = df.sparkSession, [df.columns.index(g) for g in group]
    ship(spark)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for i in at:
                column = batch.column(i)
                one, other = column.slice(1), column.slice(0, n - 1)
                equal = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(pc.is_null(one), pc.is_null(other)))
                new[1:] |= ~equal.to_numpy(zero_copy_only=False)
            new[0] = tuple(batch.column(i)[0].as_py() for i in at) != last
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, -1 - carry if not new[0] else 0))
            ranks = place - start
            last, carry = tuple(batch.column(i)[n - 1].as_py() for i in at), int(ranks[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "_rank"])

    ranged = df.repartitionByRange(*[F.col(g).asc() for g in group], *order).sortWithinPartitions(*[F.col(g).asc() for g in group], *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_rank", T.LongType())])
    parted = settle(ranged.mapInArrow(rank, schema), scratch(spark, "ordered"))
    key = F.struct(*group)
    ends = parted.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("_rank", F.struct(*group, "_rank")).alias("rank"))
    offsets, held, n = [], None, 0
    for r in ends.orderBy("_part").collect():  # a row a partition
        offset = n if held == tuple(r.first) else 0
        if offset:
            offsets.append((r["_part"], *r.first, offset))
        n, held = r["rank"] + 1 + (offset if r.first == r.last else 0), tuple(r.last)
    number = F.col("_rank")
    if offsets:
        fields = [T.StructField("_p", T.IntegerType()), *(T.StructField(f"_g{i}", df.schema[g].dataType) for i, g in enumerate(group)), T.StructField("_offset", T.LongType())]
        same = F.col("_part") == F.col("_p")
        for i, g in enumerate(group):
            same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
        parted = parted.join(F.broadcast(spark.createDataFrame(offsets, T.StructType(fields))), same, "left")
        number += F.coalesce("_offset", F.lit(0))
    return parted.select(*df.columns, number.cast("long").alias(name))


def last_before(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that is not null among the rows of its group up to and including each row, by ascending columns."""
    parted = _parted(df.withColumn("_value", value), group, [F.col(o).asc() for o in order])
    upto = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = parted.withColumn("_own", F.last("_value", ignorenulls=True).over(upto))
    final = F.max_by("_own", F.struct(*order)) if order else F.last("_own")
    ends = carried.groupBy(*group, "_part").agg(final.alias("_end"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return carried.join(ends, same).select(*df.columns, F.coalesce("_own", "_before").alias(name))
