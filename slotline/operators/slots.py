"""The slot calendar: staff x slot options x weeks, with local and UTC times."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions import timeops
from slotline.sources.dimensions import option_of, options_array


def staff_slots(staff: DataFrame) -> DataFrame:
    """Every staff member with every slot option, without a join: the options are exploded in place."""
    return staff.select("staff_id", F.inline(options_array()))


def slot_fields(rows: DataFrame, key: str = "slot_key") -> DataFrame:
    """Weekday, hour and minute of each row's slot key; an unknown key falls to the last option."""
    o = option_of(key)
    return rows.select("*", o.weekday.alias("weekday"), o.hour.alias("hour"), o.minute.alias("minute"))


def slot_calendar(staff: DataFrame, as_of: date, weeks: int) -> DataFrame:
    """The slots of each staff member over the given number of weeks after `as_of`.

    Week k's slots are those strictly after as_of + 7 k, each on its own weekday.
    """
    rows = staff_slots(staff).withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    day = timeops.next_weekday(F.date_add(F.lit(as_of), F.col("week") * 7), F.col("weekday"))
    start = timeops.at_time(day, F.col("hour"), F.col("minute"))
    rows = rows.withColumn("start_local", start)
    end = timeops.slot_end("start_local")
    return rows.select(
        "staff_id", "week", "slot_no", "slot_key", "label", "start_local", end.alias("end_local"),
        timeops.to_utc("start_local").alias("start_utc"), timeops.to_utc(end).alias("end_utc"),
    )
