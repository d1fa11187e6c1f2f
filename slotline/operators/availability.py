"""Which slots are open: an interval anti-join against busy times, its complement and the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline.functions.timeops import SLOT_MINUTES


def _islands(rows: DataFrame, *group: str) -> DataFrame:
    """Within each group the unions of intervals that overlap or touch: an interval that begins after all before it have ended opens a new one."""
    w = Window.partitionBy(*group).orderBy("busy_start", "busy_end")
    until = F.max("busy_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("busy_start") <= until, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_island", island).groupBy(*group, "_island").agg(F.min("busy_start").alias("busy_start"), F.max("busy_end").alias("busy_end")).drop("_island")


def merged_busy(busy: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """staff_id, busy_start, busy_end: each staff member's busy time as disjoint intervals, within `first` and `last` if given.

    Intervals are merged within the day in which they begin first, which spreads one staff
    member's calendar over tasks, and what is left of each day, a few intervals, once more.
    Empty and reversed intervals go, and those without a staff member or an end.
    """
    start, end = F.col("busy_start"), F.col("busy_end")
    if first is not None:
        start = F.greatest(start, first)
    if last is not None:
        end = F.least(end, last)
    rows = busy.filter("staff_id is not null and busy_start < busy_end").select("staff_id", start.alias("busy_start"), end.alias("busy_end")).filter("busy_start < busy_end").distinct()
    days = _islands(rows.withColumn("_day", F.to_date("busy_start")), "staff_id", "_day")
    return _islands(days.drop("_day"), "staff_id")


def _by_day(busy: DataFrame) -> DataFrame:
    """Each busy interval on every day on which a slot that it touches may start."""
    first = F.to_date(F.col("busy_start") - F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES"))
    return busy.filter("busy_start < busy_end").withColumn("busy_day", F.explode(F.sequence(first, F.to_date("busy_end"))))


def _overlap(slots: DataFrame, busy: DataFrame) -> Column:
    """Half-open intervals of one staff member that share a moment; the day keeps one member's calendar out of a single join key."""
    same = (slots.staff_id == busy.staff_id) & (F.to_date(slots.start_utc) == busy.busy_day)
    return same & (busy.busy_start < slots.end_utc) & (busy.busy_end > slots.start_utc)


def open_slots(slots: DataFrame, busy: DataFrame) -> DataFrame:
    """The slots (of SLOT_MINUTES) that no busy interval of their staff member touches."""
    busy = _by_day(busy)
    return slots.join(busy, _overlap(slots, busy), "left_anti")


def taken_slots(slots: DataFrame, busy: DataFrame) -> DataFrame:
    """The complement of `open_slots`."""
    busy = _by_day(busy)
    return slots.join(busy, _overlap(slots, busy), "left_semi")


def availability(slots: DataFrame, busy: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """All slots with `available` (null if the check failed), `offered` and `availability_known`.

    `checks` (staff_id, checked, ok) says whose calendar was looked at. Without a check every
    slot is offered; a failed check offers none. A staff member without a row in `checks` counts
    as checked; `checks` has a row a staff member at most. A slot that is given twice comes once.
    """
    busy = _by_day(busy)
    met = slots.join(busy, _overlap(slots, busy), "left").select(*[slots[c] for c in slots.columns], busy.busy_day)
    rows = met.groupBy(*slots.columns).agg(F.count("busy_day").alias("_hits")).withColumn("taken", F.when(F.col("_hits") > 0, F.lit(True))).drop("_hits")
    if checks is not None:
        rows = rows.join(checks.select("staff_id", "checked", "ok"), "staff_id", "left")
    else:
        rows = rows.withColumn("checked", F.lit(True)).withColumn("ok", F.lit(True))
    checked, ok = F.coalesce("checked", F.lit(True)), F.coalesce("ok", F.lit(True))
    available = F.when(checked & ok, F.col("taken").isNull())
    return rows.withColumn("available", available).withColumn("availability_known", checked & ok).withColumn(
        "offered", F.when(~checked, F.lit(True)).otherwise(F.coalesce(available, F.lit(False)))
    ).drop("taken", "checked", "ok")


def with_fallback(rows: DataFrame) -> DataFrame:
    """The offered slots; a staff member without any gets all of them, flagged `fallback`."""
    n_open = F.sum(F.col("offered").cast("int")).over(Window.partitionBy("staff_id"))
    rows = rows.withColumn("n_open", n_open)
    return rows.filter(F.col("offered") | (F.col("n_open") == 0)).withColumn("fallback", F.col("n_open") == 0).drop("n_open")


def open_labels(rows: DataFrame) -> DataFrame:
    """Each staff member's offered labels, in slot order."""
    labels = F.array_sort(F.collect_set(F.when(F.col("offered"), F.struct("week", "slot_no", "label"))))
    return rows.groupBy("staff_id").agg(F.transform(labels, lambda x: x.label).alias("labels"))


def availability_map(rows: DataFrame) -> DataFrame:
    """Each staff member's slots as a map from start time to (offered, end)."""
    entry = F.struct(F.col("start_utc").alias("key"), F.struct("offered", "end_utc").alias("value"))
    return rows.groupBy("staff_id").agg(F.map_from_entries(F.collect_set(entry)).alias("slots"))


def any_open(rows: DataFrame) -> DataFrame:
    return rows.groupBy("staff_id").agg(F.bool_or("offered").alias("any_open"), F.count_if("offered").alias("n_open"))


def open_slots_merged(slots: DataFrame, busy: DataFrame) -> DataFrame:
    """`open_slots` by the union of busy times within the calendar: a slot meets an interval or two, however many overlap or however long they are."""
    first, last = slots.agg(F.min("start_utc").cast("string"), F.max("end_utc").cast("string")).first()
    if first is None:
        return slots
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
    return open_slots(slots, merged_busy(busy.filter((F.col("busy_end") > first) & (F.col("busy_start") < last)), first, last))
