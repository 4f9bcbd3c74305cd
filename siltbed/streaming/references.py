"""Orphan references on a stream, whose rows may come in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.operators.orphans import CELLS, DAY, EVENTS, KEY, REFS, State, advance
from siltbed.session import scratch, settle
from siltbed.streaming.versions import Versions


def watch(rows: DataFrame, versions: Versions, checkpoint: str, slice_micros: int = DAY, lateness: int | None = None, **trigger) -> StreamingQuery:
    """rows: ref_table, store_id, target, at, and either ref_id (a reference) or delta (+1 a target came, -1 it went).

    Each version has the batch's changes (+1 became an orphan, -1 was resolved), the orphans that became final, the number of rows
    too late, and the state of the keys, of which only touched buckets are read and written. lateness: microseconds
    behind the latest time seen after which rows are too late; without it the state keeps every reference.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, versions.before(number)
        batch = settle(batch.select("ref_table", F.col("store_id").cast("int").alias("store_id"), "target", "at", "ref_id", "delta"), scratch(spark, "batch"))
        mine = versions.touched(batch.where("target is not null"), KEY)
        latest = max((t for t in (versions.note(last, "latest"), batch.agg(F.max("at")).first()[0]) if t is not None), default=None)
        floor = None if lateness is None or latest is None else (latest - lateness) // slice_micros
        state = State(*(versions.keyed(last, name, schema, mine) for name, schema in (("refs", REFS), ("events", EVENTS), ("cells", CELLS))), versions.note(last, "floor"))
        refs = batch.where("ref_id is not null").select("ref_table", "ref_id", "store_id", "target", "at")
        events = batch.where("delta is not null and at is not null and target is not null and store_id is not null").select(*KEY, "at", "delta")
        done = advance(state, refs, events, slice_micros, scratch(spark, "watch"), floor)
        kept = {"refs": (done.state.refs, KEY, mine), "events": (done.state.events, KEY, mine), "cells": (done.state.cells, KEY, mine)}
        versions.write(number, kept, {"latest": latest, "floor": done.state.floor}, changes=done.changes, final=done.final, late=done.late)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def orphans(versions: Versions, since: int = 0) -> DataFrame:
    """ref_table, ref_id, at of the present orphans: those in the state, and the final ones of the versions from since on."""
    last = versions.before(1 << 62)
    out = versions.keyed(last, "refs", REFS).where("orphan").select("ref_table", "ref_id", "at")
    for number in versions._numbers():
        if number >= since:
            out = out.unionByName(versions.read(number, "final"))
    return out


def open_references(versions: Versions) -> DataFrame:
    """Per table, references seen so far whose target is not there now."""
    cells = versions.keyed(versions.before(1 << 62), "cells", CELLS)
    now = cells.groupBy(*KEY).agg(F.sum("delta").alias("live"), F.sum("refs").alias("refs"))
    return now.where("live <= 0 and refs > 0").groupBy("ref_table").agg(F.sum("refs").alias("open"))
