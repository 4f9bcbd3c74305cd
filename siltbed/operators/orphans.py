"""References to records that are missing, deleted or arrive later.

State is kept per referred key: when its targets came and went, the references whose answer may still change, and the
counts of both in slices of time. A batch of references and of target arrivals and removals is folded in by
`advance`, in whatever order batches and rows come: new references probe the index at their own time; a target
that comes late resolves the references it was there for, a removal that comes late reopens them. Each fold gives the
changes, +1 where a reference becomes an orphan and -1 where one is resolved. Only keys that a batch touches are
folded again. No join of references with targets is made: both are united and swept in order of time inside
cells of (key, time slice).

A floor bounds the state: what lies below it is final and leaves the state, its targets as one number per key. Rows that come later
than that are not folded but returned as late. Without a floor every answer stays open.

A key with very many references is spread over the time slices, whose number grows with the
number of rows; what precedes a slice enters it as one carried row.

Nulls: a reference without a key is none. A reference without a time, or without a store, has
no target. A target without a beginning was never there; one that ends at or before its
beginning neither. Repeated target rows are each a target; repeated references come out each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.session import scratch, settle

KEY = ["ref_table", "store_id", "target"]
DAY = 86_400_000_000
#: About so many rows a slice of time may hold on average.
ROWS_PER_SLICE = 50_000
LEAST_SLICES = 64

_KEYS = "ref_table string, store_id int, target string"
REFS, EVENTS = f"{_KEYS}, slice long, ref_id long, at long, orphan boolean", f"{_KEYS}, slice long, at long, delta long"
CELLS, FOUND = f"{_KEYS}, slice long, refs long, delta long", "ref_table string, ref_id long, at long"


@dataclass
class State:
    """References that are open to change, target events as long as they matter, counts by slice (null: all below the floor)."""

    refs: DataFrame
    events: DataFrame
    cells: DataFrame
    floor: int | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(*(spark.createDataFrame([], s) for s in (REFS, EVENTS, CELLS)))


@dataclass
class Ledger:
    """What a fold leaves.

    changes: ref_table, ref_id, at, change (+1 became an orphan, -1 was resolved). final: the orphans (ref_table, ref_id, at) among the
    references that left the state. opened: changes of open references per table and day. late: number of rows below the state's floor.
    """

    state: State
    final: DataFrame
    changes: DataFrame
    opened: DataFrame
    late: DataFrame
    earlier: list[DataFrame] = field(default_factory=list)

    @property
    def orphans(self) -> DataFrame:
        """Orphans as of now: final ones, of earlier folds too, and those in the state."""
        out = self.final.unionByName(self.state.refs.where("orphan").select("ref_table", "ref_id", "at"))
        for more in self.earlier:
            out = out.unionByName(more)
        return out


def target_events(targets: DataFrame) -> DataFrame:
    """Arrivals (+1) and removals (-1) of targets (ref_table, store_id, target, starts, ends)."""
    there = targets.where("starts is not null and target is not null and store_id is not null and (ends is null or ends > starts)")
    both = F.explode(F.array(F.struct(F.col("starts").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("ends").alias("at"), F.lit(-1).alias("delta"))))
    return there.select(*KEY, both.alias("e")).select(*KEY, "e.at", "e.delta").where("at is not null")


def advance(state: State, refs: DataFrame, events: DataFrame, slice_micros: int, keep_at: str, floor: int | None = None) -> Ledger:
    """Fold one batch into the state, which is written to keep_at.

    refs: ref_table, ref_id, store_id, target, at. events: see target_events(). Times are
    microseconds. floor: the slice below which everything is final from now on.
    """
    key_slice = [*KEY, "slice"]
    floor = max((f for f in (floor, state.floor) if f is not None), default=None)
    final = F.lit(False) if floor is None else F.col("slice") < floor
    refs = refs.where("target is not null")
    untimed = refs.where("at is null or store_id is null").select("ref_table", "ref_id", "at")
    slice_of = F.floor(F.col("at") / slice_micros)
    timed = refs.where("at is not null and store_id is not null").select(*KEY, slice_of.alias("slice"), "ref_id", "at", F.lit(False).alias("orphan"), F.lit(True).alias("new"))
    events = events.select(*KEY, slice_of.alias("slice"), "at", F.col("delta").cast("long").alias("delta"))
    late = None
    if state.floor is not None:
        below = F.col("slice") < state.floor
        late = timed.where(below).select("ref_table").unionByName(events.where(below).select("ref_table"))
        timed, events = timed.where(~below), events.where(~below)
    late = (timed.limit(0).select("ref_table") if late is None else late).groupBy("ref_table").agg(F.count("*").alias("late"))

    none = F.lit(0).cast("long")
    counted = timed.groupBy(*key_slice).agg(F.count("*").alias("refs")).withColumn("delta", none)
    moved = events.groupBy(*key_slice).agg(F.sum("delta").alias("delta")).withColumn("refs", none)
    added = counted.unionByName(moved).withColumn("was_refs", none).withColumn("was_delta", none)
    known = state.cells.select(*key_slice, "refs", "delta", F.col("refs").alias("was_refs"), F.col("delta").alias("was_delta"))
    numbers = ["refs", "delta", "was_refs", "was_delta"]
    cells = added.unionByName(known).groupBy(*key_slice).agg(*(F.sum(c).alias(c) for c in numbers))

    by_key = Window.partitionBy(*KEY).orderBy(F.col("slice").asc_nulls_first())
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(*key_slice, *numbers, *(F.sum(c).over(so_far).alias(f"all_{c}") for c in numbers))
    open_ = lambda live, waiting: F.when(F.col(live) <= 0, F.col(waiting)).otherwise(0)
    cells = cells.withColumn("open", open_("all_delta", "all_refs")).withColumn("was_open", open_("all_was_delta", "all_was_refs"))
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(by_key), F.lit(0))
    cells = settle(cells.select(*key_slice, "refs", "delta", (F.col("all_delta") - F.col("delta")).alias("before"), (step("open") - step("was_open")).alias("opened")), f"{keep_at}/cells")
    opened = (
        cells.where("slice is not null")
        .groupBy("ref_table", F.floor(F.col("slice") * slice_micros / DAY).alias("day"))
        .agg(F.sum("opened").alias("opened"))
    )
    kept_cells = cells.select(*KEY, F.when(~final, F.col("slice")).alias("slice"), "refs", "delta").groupBy(*key_slice).agg(F.sum("refs").alias("refs"), F.sum("delta").alias("delta"))

    # Only keys with new rows are swept again; a state whose answers are all final has nothing to sweep.
    rest = None
    if state.refs.limit(1).count() or state.events.limit(1).count():
        touched = timed.select(*KEY).unionByName(events.select(*KEY)).distinct()
        rest = state.refs.join(touched, KEY, "left_anti"), state.events.join(touched, KEY, "left_anti")
        timed = timed.unionByName(state.refs.join(touched, KEY, "left_semi").withColumn("new", F.lit(False)).select(timed.columns))
        events = events.unionByName(state.events.join(touched, KEY, "left_semi").select(events.columns))
    carried = cells.where("slice is not null and before != 0").select(*key_slice, (F.col("slice") * slice_micros - 1).alias("at"), F.col("before").alias("delta"))
    nothing = [F.lit(None).cast("long").alias("ref_id"), F.lit(False).alias("orphan"), F.lit(False).alias("new"), F.lit(False).alias("is_ref")]
    sweep = (
        timed.select(*key_slice, "at", none.alias("delta"), "ref_id", "orphan", "new", F.lit(True).alias("is_ref"))
        .unionByName(events.select(*key_slice, "at", "delta", *nothing))
        .unionByName(carried.select(*key_slice, "at", "delta", *nothing))
    )
    # The frame of peers makes arrivals and removals at the very time of a reference count.
    in_slice = Window.partitionBy(*key_slice).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = sweep.withColumn("live", F.coalesce(F.sum("delta").over(in_slice), F.lit(0))).where("is_ref").withColumn("now", F.col("live") <= 0)
    changes = swept.where("now != orphan").select("ref_table", "ref_id", "at", F.when(F.col("now"), 1).otherwise(-1).alias("change"))
    changes = changes.unionByName(untimed.withColumn("change", F.lit(1)))
    found = swept.where("now").where(final).select("ref_table", "ref_id", "at").unionByName(untimed)
    kept_refs = swept.where(~final).select(*key_slice, "ref_id", "at", F.col("now").alias("orphan"))
    kept_events = events.where(~final)
    if rest is not None:
        found = found.unionByName(rest[0].where(final & F.col("orphan")).select("ref_table", "ref_id", "at"))
        kept_refs, kept_events = kept_refs.unionByName(rest[0].where(~final).select(kept_refs.columns)), kept_events.unionByName(rest[1].where(~final).select(kept_events.columns))
    kept = State(settle(kept_refs, f"{keep_at}/refs"), settle(kept_events, f"{keep_at}/events"), settle(kept_cells, f"{keep_at}/counts"), floor)
    return Ledger(kept, found, changes, opened, late)


def slice_width(length: int, rows: int) -> int:
    """Microseconds of a slice for so many rows over a length of time; a whole number of slices make a day, so that counts add up by day."""
    wanted = max(1, length // max(LEAST_SLICES, rows // ROWS_PER_SLICE))
    parts = max(1, -(-DAY // wanted))
    while DAY % parts:  # a day's microseconds have only the factors 2, 3 and 5, so the next fit is near
        parts += 1
    return DAY // parts


def fold_all(batches: list[tuple[DataFrame, DataFrame]], slice_micros: int, floors: list[int | None] | None = None) -> Ledger:
    """Batches (references, target events) folded one after the other, in any order; floors: one after each."""
    spark = batches[0][0].sparkSession
    state, earlier, opened, late, changes, done = State.empty(spark), [], None, None, None, None
    for k, (refs, events) in enumerate(batches):
        if done is not None:
            earlier.append(done.final)
        done = advance(state, refs, events, slice_micros, scratch(spark, "orphans"), floors[k] if floors else None)
        state = done.state
        more = lambda old, new: new if old is None else old.unionByName(new)
        opened, late, changes = more(opened, done.opened), more(late, done.late), more(changes, done.changes)
    return Ledger(state, done.final, changes, opened, late, earlier)


def replay(refs: DataFrame, targets: DataFrame, batches: int = 3) -> Ledger:
    """The whole history, folded in that many consecutive batches of equal length in time; each is final when the next begins."""
    span = refs.where("target is not null").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).first()
    lo, hi = (span.lo or 0), (span.hi or 0)
    width = slice_width(hi - lo, span.n)
    cuts = sorted({((lo + (hi - lo) * k // batches) // width + 1) * width for k in range(1, batches)})
    events, parts = target_events(targets), []
    for since, till in zip([None, *cuts], [*cuts, None]):
        span_of = lambda df: df.where(
            (F.lit(True) if since is None else F.col("at") >= since) & (F.lit(True) if till is None else F.col("at") < till)
            | (F.col("at").isNull() if since is None else F.lit(False))
        )
        parts.append((span_of(refs), span_of(events)))
    # Nothing comes after the last batch, so it is final too.
    return fold_all(parts, width, [*(c // width for c in cuts), 1 << 62])


def day_of(day) -> F.col:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def daily(ledger: Ledger) -> DataFrame:
    """Per table and day: references that came as orphans, and those open at the end of the day.

    Days without a change and without an orphan have no row. References without a time are in no day.
    """
    came = ledger.orphans.where("at is not null").groupBy("ref_table", F.floor(F.col("at") / DAY).alias("day")).agg(F.count("*").alias("orphans"))
    moved = ledger.opened.groupBy("ref_table", "day").agg(F.sum("opened").alias("opened"))
    both = came.join(moved, ["ref_table", "day"], "full").na.fill(0, ["orphans", "opened"])
    so_far = Window.partitionBy("ref_table").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        both.withColumn("open_at_end", F.sum("opened").over(so_far))
        .where("orphans != 0 or opened != 0")
        .select("ref_table", day_of(F.col("day")).alias("day"), "orphans", "open_at_end")
    )
