"""Landed calendar responses: free/busy answers and event answers as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.timeops import ntz_of

FREEBUSY = "calendars map<string,struct<busy:array<struct<start:timestamp,end:timestamp>>,errors:array<struct<reason:string>>>>"
EVENT = "htmlLink string, conferenceData struct<entryPoints:array<struct<entryPointType:string,uri:string>>>"


def freebusy(landed: DataFrame) -> DataFrame:
    """staff_id, checked, ok, calendar_known, n_busy and the busy list of each landed answer (staff_id, checked, ok, payload).

    A calendar that the answer lacks, or that has no busy list, counts as free but isn't known.
    """
    rows = landed.withColumn("calendars", F.from_json("payload", FREEBUSY).calendars)
    found = F.try_element_at("calendars", F.col("staff_id").cast("string"))
    busy = F.coalesce(found.busy, F.array().cast("array<struct<start:timestamp,end:timestamp>>"))
    return rows.select("staff_id", "checked", "ok", found.busy.isNotNull().alias("calendar_known"), F.size(busy).alias("n_busy"), busy.alias("busy"))


def busy_intervals(answers: DataFrame) -> DataFrame:
    """staff_id, busy_start, busy_end (UTC) of the answers of `freebusy`."""
    one = answers.select("staff_id", F.explode("busy").alias("b"))
    return one.select("staff_id", ntz_of("b.start").alias("busy_start"), ntz_of("b.end").alias("busy_end"))


def event_links(payload: Column | str) -> tuple[Column, Column]:
    """Event link and meeting link of an event answer; of several video links the last one."""
    event = F.from_json(payload, EVENT)
    points = F.coalesce(event.conferenceData.entryPoints, F.array().cast("array<struct<entryPointType:string,uri:string>>"))
    video = F.try_element_at(F.filter(points, lambda p: p.entryPointType == "video"), F.lit(-1)).uri
    return event.htmlLink, video
