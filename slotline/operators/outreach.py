"""What is due to be sent: messages, calendar links, event and free/busy requests, merged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions import timeops
from slotline.functions.text import CONFIRMED, filled, or_default, request_id, url_quote
from slotline.operators.bookings import needs_event
from slotline.sources.landed_json import event_links


def message_body(name: str = "name", slot: str = "slot_key", link: str = "meet_link") -> Column:
    """A confirmation's text; the link's line only where there is one."""
    text = F.concat(F.lit("Hi "), or_default(name, "there"), F.lit(", your session "), F.coalesce(slot, F.lit("")), F.lit(" is confirmed."))
    return F.concat(text, F.when(filled(link), F.concat(F.lit(" Join: "), F.col(link))).otherwise(F.lit("")))


def outreach_feed(rows: DataFrame) -> DataFrame:
    """One message for each booking with a recipient."""
    return rows.filter(filled(F.trim(F.col("email")))).select("booking_id", F.col("email").alias("recipient"), F.concat(F.lit("Session "), F.coalesce("slot_key", F.lit(""))).alias("subject"), message_body().alias("body"))


def calendar_link(title: Column | str, start_utc: Column | str, end_utc: Column | str, details: Column | str) -> Column:
    """A link to a pre-filled calendar entry."""
    dates = F.concat(timeops.compact_utc(start_utc), F.lit("/"), timeops.compact_utc(end_utc))
    return F.concat(F.lit("https://calendar.example.com/render?action=TEMPLATE&text="), url_quote(title), F.lit("&dates="), dates, F.lit("&details="), url_quote(details))


def event_request(rows: DataFrame, office: str, attend: bool = True) -> DataFrame:
    """booking_id and the JSON that asks for a calendar event (name, email, start_utc, end_utc, message).

    Attendees are the customer, unless blank or left out, and the office.
    """
    people = F.filter(F.array(*([F.col("email")] if attend else []), F.lit(office)), lambda x: x.isNotNull() & (x != ""))
    when = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime"), F.lit("UTC").alias("timeZone"))
    body = F.struct(
        F.concat(F.lit("Session with "), F.coalesce("name", F.lit(""))).alias("summary"),
        F.coalesce("message", F.lit("")).alias("description"),
        when("start_utc").alias("start"),
        when("end_utc").alias("end"),
        F.transform(people, lambda x: F.struct(x.alias("email"))).alias("attendees"),
        F.struct(F.struct(request_id("booking_id").alias("requestId")).alias("createRequest")).alias("conferenceData"),
    )
    return rows.select("booking_id", F.to_json(body).alias("request"))


def event_requests(rows: DataFrame, office: str) -> DataFrame:
    """Requests for all bookings that still lack an event."""
    return event_request(needs_event(rows), office)


def freebusy_request(rows: DataFrame) -> DataFrame:
    """staff_id and the JSON that asks for its busy times (staff_id, start_utc, end_utc)."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(iso("start_utc").alias("timeMin"), iso("end_utc").alias("timeMax"), F.array(F.struct(F.col("staff_id").cast("string").alias("id"))).alias("items"))
    return rows.select("staff_id", "start_utc", F.to_json(body).alias("request"))


def merge_responses(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """All bookings; those with an answer (booking_id, at, payload) get its links and are confirmed.

    Of several answers to one booking the latest counts, of those of one time the last in order
    of their links; one without a time is before all others.
    """
    link, meet = event_links("payload")
    got = responses.select("booking_id", F.struct("at", link.alias("event_link"), meet.alias("meet_link")).alias("r")).groupBy("booking_id").agg(F.max("r").alias("r"))
    out = rows.join(got, "booking_id", "left")
    new = {
        "event_link": F.coalesce("r.event_link", "event_link"),
        "meet_link": F.coalesce("r.meet_link", "meet_link"),
        "status": F.when(F.col("r").isNotNull(), F.lit(CONFIRMED)).otherwise(F.col("status")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], F.col("r.at").alias("confirmed_utc"))
