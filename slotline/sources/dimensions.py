"""Fixed dimensions: slot options, as literals, so that they never have to be joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number, key, label, weekday (0 is Monday), hour, minute.
SLOT_OPTIONS = (
    (1, "sat_18_00", "Sat 6:00 PM CST (30 min)", 5, 18, 0),
    (2, "sun_11_00", "Sun 11:00 AM CST (30 min)", 6, 11, 0),
    (3, "sun_15_00", "Sun 3:00 PM CST (30 min)", 6, 15, 0),
    (4, "sun_18_00", "Sun 6:00 PM CST (30 min)", 6, 18, 0),
)
FIELDS = ("slot_no", "slot_key", "label", "weekday", "hour", "minute")


def options_array() -> Column:
    """All slot options as one array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(f) for v, f in zip(row, FIELDS, strict=True)]) for row in SLOT_OPTIONS])


def option_of(key: Column | str) -> Column:
    """The option of a slot key; an unknown or null key falls to the last one."""
    key = F.col(key) if isinstance(key, str) else key
    all_ = options_array()
    return F.coalesce(F.try_element_at(F.filter(all_, lambda o: o.slot_key == key), F.lit(1)), F.element_at(all_, -1))
