"""The fold over the action log in parts: a snapshot of all actions so far, and what came since.

A partial state holds, for each booking, what two parts of its log need to be merged: links
keep the time of their action. Merging is free of order and grouping, so that any split of a
log gives the state of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions.text import CONFIRMED, PENDING, filled
from slotline.operators.bookings import CONFIRMING

PARTS = ("confirming", "confirmed_utc", "email_sent_utc", "event", "meet")


def partial_state(actions: DataFrame, at: str = "at") -> DataFrame:
    """booking_id and PARTS of a part of the log. Actions without a booking are one booking, as in `booking_state`."""
    action, when = F.col("action"), F.col(at)
    link = lambda c: F.max(F.when(filled(c), F.struct(when.alias("at"), F.col(c).alias("link"))))
    return actions.groupBy("booking_id").agg(
        F.coalesce(F.bool_or(action.isin(*CONFIRMING)), F.lit(False)).alias("confirming"),
        F.max(F.when(action.isin("event_created", "confirmed"), when)).alias("confirmed_utc"),
        F.max(F.when(action.isin("email_sent", "email_marked"), when)).alias("email_sent_utc"),
        link("event_link").alias("event"),
        link("meet_link").alias("meet"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """Partial states of several parts of a log as one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("booking_id").agg(*[F.max(c).alias(c) for c in PARTS])


def advance(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """The snapshot after more actions, by a join on the booking: one that is bucketed by it isn't shuffled."""
    new = partial_state(actions)
    old, own = snapshot.filter("booking_id is not null"), new.filter("booking_id is not null")
    own = own.select("booking_id", *[F.col(c).alias(f"new_{c}") for c in PARTS])
    known = old.join(own, "booking_id", "full").select("booking_id", *[F.greatest(c, f"new_{c}").alias(c) for c in PARTS])
    return known.unionByName(merged(snapshot.filter("booking_id is null"), new.filter("booking_id is null")))


def state_of(partial: DataFrame) -> DataFrame:
    """The columns of `booking_state`."""
    status = F.when(F.col("confirming"), F.lit(CONFIRMED)).otherwise(F.lit(PENDING))
    return partial.select("booking_id", status.alias("status"), "confirmed_utc", "email_sent_utc", F.col("event.link").alias("event_link"), F.col("meet.link").alias("meet_link"))


def save_by_booking(rows: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Rows as a table in buckets of the booking, within which folds and joins on it need no exchange.

    Rows are dealt by the same hash as the buckets, so that a bucket is one file. A booking's
    own actions are few: no booking is a hot key of its log.
    """
    rows.repartition(buckets, "booking_id").write.bucketBy(buckets, "booking_id").sortBy("booking_id").option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    """Forget a table of `save_by_booking`; its files stay."""
    spark.sql(f"drop table if exists {table}")
