"""Bookings: status, review, updates, the fold over the action log, duplicates and clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.text import CONFIRMED, PENDING, filled, status_of
from slotline.functions.timeops import micros_of
from slotline.operators.ordering import number_rows

ALL = "all"
CONFIRMING = ("event_created", "confirmed", "email_sent")


def with_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", status_of())


def status_filter(rows: DataFrame, status: str) -> DataFrame:
    rows = with_status(rows)
    return rows if status == ALL else rows.filter(F.col("status") == status)


def distinct_status(rows: DataFrame) -> DataFrame:
    return with_status(rows).select("status").distinct()


def status_options(rows: DataFrame) -> DataFrame:
    """The statuses in order, with `all` before them: place, status."""
    found = distinct_status(rows).agg(F.array_sort(F.collect_set("status")).alias("s"))  # a few different values
    return found.select(F.posexplode(F.concat(F.array(F.lit(ALL)), "s")).alias("place", "status"))


def status_funnel(rows: DataFrame, slot: str = "slot_key") -> DataFrame:
    return with_status(rows).groupBy("status", slot).agg(F.count(F.lit(1)).alias("n"))


def review_rows(rows: DataFrame) -> DataFrame:
    """What a reviewer sees of a booking."""
    rows = with_status(rows)
    links = F.concat_ws(" ", F.nullif("event_link", F.lit("")), F.nullif("meet_link", F.lit("")))
    return rows.select("booking_id", F.concat_ws(" - ", "name", "email", "slot_key").alias("title"), "status", "message", links.alias("links"))


def numbered(rows: DataFrame, day: str = "created") -> DataFrame:
    """Numbers from 1 within each status and day, in order of time and id.

    The whole list is numbered, which deals a hot day over tasks, and each day's first number
    is taken off: a row for each status and day, which is broadcast (a century has 36,525 days).
    """
    listed = number_rows(with_status(rows).withColumn("_day", F.to_date(day)), "status", "_day", day, "booking_id")
    first = listed.groupBy(F.col("status").alias("_status"), F.col("_day").alias("_first_day")).agg(F.min("number").alias("_first"))
    out = listed.join(F.broadcast(first), (F.col("status") == F.col("_status")) & F.col("_day").eqNullSafe(F.col("_first_day")))
    return out.withColumn("number", (F.col("number") - F.col("_first") + 1).cast("int")).drop("_day", "_status", "_first_day", "_first")


def numbered_list(rows: DataFrame, status: str = ALL, at: str = "created", id_: str = "booking_id") -> DataFrame:
    """The bookings of a status with numbers from 1 over the whole list, in order of time and id; those without a time come first."""
    return number_rows(status_filter(rows, status), F.col(at).asc_nulls_first(), F.col(id_).asc_nulls_first())


def has_link(rows: DataFrame) -> DataFrame:
    return rows.filter(filled("event_link"))


def needs_event(rows: DataFrame) -> DataFrame:
    return rows.filter(~filled("event_link"))


def apply_updates(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "booking_id") -> DataFrame:
    """All rows, with the columns of their change where it has one.

    Of several changes of one key the largest counts, by the columns in turn, so that no row
    is doubled; a change of no row, and one without a key, is none.
    """
    largest = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    new = largest.select(F.col(key), *[F.col(f"_new.{c}").alias(f"new_{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def state_aggregates(at: str = "at") -> list[Column]:
    """The fold over a booking's actions, free of their order, so that it also runs on a stream.

    A booking is confirmed once its event is created, it is confirmed by hand, or its mail is
    sent while no status was ever set (an absent status is the one that a mail replaces).
    Times take the latest, links the latest that aren't blank; of links of one time the last
    in order of text counts, so that a batch and a stream agree.
    """
    action, when = F.col("action"), F.col(at)
    link = lambda c: F.max(F.when(filled(c), F.struct(when.alias("at"), F.col(c).alias("link"))))["link"]
    return [
        F.coalesce(F.max(F.when(action.isin(*CONFIRMING), F.lit(CONFIRMED))), F.lit(PENDING)).alias("status"),
        F.max(F.when(action.isin("event_created", "confirmed"), when)).alias("confirmed_utc"),
        F.max(F.when(action.isin("email_sent", "email_marked"), when)).alias("email_sent_utc"),
        link("event_link").alias("event_link"),
        link("meet_link").alias("meet_link"),
    ]


def booking_state(actions: DataFrame) -> DataFrame:
    """The latest state of each booking of an append-only action log."""
    return actions.groupBy("booking_id").agg(*state_aggregates())


def dedup_bookings(rows: DataFrame, key: list[str], created: str, tie: str) -> DataFrame:
    """Of bookings equal in `key` the one with a link, then the latest; created times aren't part of the key.

    Of equal times the largest `tie` counts. Keys are equal where both are null. Each task
    keeps its best row of a key before the exchange, so that a hot key is no hot task.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(filled("event_link").alias("filled"), F.col(created).alias("created"), F.col(tie).alias("tie")))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_row")).select("_row.*")


def double_bookings(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """Pairs of bookings of one staff member whose intervals overlap (staff_id, id, start, end).

    Both sides are dealt to buckets of `minutes`, so that a join key holds a staff member's
    bookings of one bucket only; a pair is reported in the bucket where its overlap begins.
    Rows without a staff member or a time, and empty intervals, aren't audited; rows without an
    id are in no pair, and of a repeated id each row is.
    """
    micros = minutes * 60 * 1_000_000
    bucket = lambda x: F.floor(micros_of(x) / micros)
    dealt = rows.filter(F.col("staff_id").isNotNull() & (F.col("start") < F.col("end"))).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("start")), F.floor((micros_of("end") - 1) / micros)))
    )
    a, b = dealt.alias("a"), dealt.alias("b")
    on = F.expr("a.staff_id = b.staff_id and a.bucket = b.bucket and a.id < b.id and a.start < b.end and b.start < a.end")
    first = F.greatest(F.col("a.start"), F.col("b.start"))
    return a.join(b, on).filter(F.col("a.bucket") == bucket(first)).select(F.col("a.staff_id").alias("staff_id"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
