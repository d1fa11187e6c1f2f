"""The operators' inputs, derived from the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.operators.slots import slot_calendar

AS_OF, WEEKS = date(2024, 1, 1), 4
KEYS = ("sat_18_00", "sun_11_00", "sun_15_00", "elsewhere")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("staff_id")).distinct()


def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("staff_id"), F.col("ts").alias("busy_start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("busy_end"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_calendar(staff(spark, sf_dir), AS_OF, WEEKS)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in eleven calendars isn't looked at, one in seven can't be."""
    return staff(spark, sf_dir).select("staff_id", (F.col("staff_id") % 11 != 0).alias("checked"), (F.col("staff_id") % 7 != 0).alias("ok"))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings from orders; statuses and links have all their blank forms."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("booking_id"),
        F.col("o_orderdate").alias("created"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name"),
        F.when(key % 5 == 0, F.lit("")).when(key % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("email"),
        F.get(F.array(*map(F.lit, KEYS)), (key % 4).cast("int")).alias("slot_key"),
        F.concat(F.lit("priority "), F.col("o_orderpriority"), F.lit(' & "more"')).alias("message"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://calendar.example.com/"), key.cast("string"))).when(F.col("o_orderstatus") == "O", F.lit("")).alias("event_link"),
        F.when((F.col("o_orderstatus") == "F") & (key % 3 == 0), F.concat(F.lit("https://meet.example.com/"), key.cast("string"))).alias("meet_link"),
        F.when(F.col("o_orderstatus") == "F", F.lit("confirmed")).when(F.col("o_orderstatus") == "O", F.lit("")).alias("status"),
    )


def actions(events: DataFrame) -> DataFrame:
    """The booking action log; works on a stream of events too."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("action_id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("booking_id"),
        F.col("ts").alias("at"),
        F.when(kind == "signup", "created").when(kind == "view", "event_created").when(kind == "click", "email_marked").when(kind == "purchase", "confirmed").otherwise("email_sent").alias("action"),
        F.when(kind == "view", F.concat(F.lit("https://calendar.example.com/"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("event_link"),
        F.when((kind == "view") & (F.col("event_id") % 2 == 0), F.concat(F.lit("https://meet.example.com/"), F.col("event_id").cast("string"))).alias("meet_link"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("brand"), courses.alias("courses"))


def landed_freebusy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free/busy answer of each staff member as JSON; every fifth lacks its calendar."""
    span = F.struct(F.date_format("busy_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start"), F.date_format("busy_end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("end"))
    spans = busy(spark, sf_dir).groupBy("staff_id").agg(F.array_sort(F.collect_list(span)).alias("busy"))
    rows = checks(spark, sf_dir).join(spans, "staff_id", "left")
    known = F.when(F.col("staff_id") % 5 == 0, F.lit("nobody")).otherwise(F.col("staff_id").cast("string"))
    body = F.struct(F.create_map(known, F.struct(F.coalesce("busy", F.array().cast("array<struct<start:string,end:string>>")).alias("busy"))).alias("calendars"))
    return rows.select("staff_id", "checked", "ok", F.to_json(body).alias("payload"))


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to each view event: two video links, a phone number only, or no conference."""
    e = read(spark, sf_dir, "events").filter("event_type = 'view'")
    point = lambda kind, n: F.struct(F.lit(kind).alias("entryPointType"), F.concat(F.lit(f"{n}:"), F.col("event_id").cast("string")).alias("uri"))
    points = F.when(F.col("event_id") % 3 == 0, F.array(point("video", "first"), point("phone", "tel"), point("video", "last"))).when(F.col("event_id") % 3 == 1, F.array(point("phone", "tel")))
    body = F.struct(F.concat(F.lit("https://calendar.example.com/"), F.col("event_id").cast("string")).alias("htmlLink"), F.when(points.isNotNull(), F.struct(points.alias("entryPoints"))).alias("conferenceData"))
    return e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("booking_id"), F.col("event_id"), F.col("ts").alias("at"), F.to_json(body).alias("payload"))
