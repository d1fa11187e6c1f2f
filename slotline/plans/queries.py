"""The registered queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions import timeops
from slotline.functions.text import filled, or_default, request_id, url_quote
from slotline.operators import availability as av
from slotline.operators import bookings as bk
from slotline.operators import catalogue as cat
from slotline.operators import outreach as out
from slotline.operators import slots as sl
from slotline.operators import state as st
from slotline.plans import views as v
from slotline.sources import bookings_csv, landed_json, split_csv, versions
from slotline.sources.dimensions import SLOT_OPTIONS, option_of
from slotline.sources.scratch import new_path
from slotline.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TERM, OFFICE = "ne", "office@example.com"
BUCKETS = 64
STATE = "booking_id long, status string, confirmed_utc timestamp_ntz, email_sent_utc timestamp_ntz, event_link string, meet_link string"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _slots_of(rows: DataFrame) -> DataFrame:
    """Each booking's slot: the next one of its key after the day it was made."""
    o = option_of("slot_key")
    start = timeops.at_time(timeops.next_weekday(F.to_date("created"), o.weekday), o.hour, o.minute)
    rows = rows.withColumn("start_local", start)
    return rows.withColumn("start_utc", timeops.to_utc("start_local")).withColumn("end_utc", timeops.slot_end(timeops.to_utc("start_local")))


# Slots and times


@query
def slot_options(s: SparkSession, d: str) -> DataFrame:
    """How many events each slot option's weekday has."""
    days = v.read(s, d, "events").select(F.weekday("ts").alias("day"), F.inline(sl.options_array()))
    return days.groupBy("slot_no", "slot_key", "label", "weekday", "hour", "minute").agg(F.count_if(F.col("day") == F.col("weekday")).alias("n_events"))


@query
def staff_slots(s: SparkSession, d: str) -> DataFrame:
    return sl.staff_slots(v.staff(s, d)).select("staff_id", "slot_no", "slot_key")


@query
def slot_fields(s: SparkSession, d: str) -> DataFrame:
    return sl.slot_fields(v.bookings(s, d).select("booking_id", "slot_key"))


@query
def slot_calendar(s: SparkSession, d: str) -> DataFrame:
    return v.calendar(s, d)


@query
def next_weekday(s: SparkSession, d: str) -> DataFrame:
    day = v.read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    wanted = (F.col("o_orderkey") % 7).cast("int")
    return day.select("o_orderkey", timeops.next_weekday("day", wanted).cast("string").alias("next_day"), F.next_day("day", "SUN").cast("string").alias("next_sunday"))


@query
def slot_times(s: SparkSession, d: str) -> DataFrame:
    rows = _slots_of(v.bookings(s, d))
    return rows.select("booking_id", "start_local", timeops.slot_end("start_local").alias("end_local"))


@query
def slot_utc(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", timeops.to_utc("created").alias("created_utc"))


@query
def slot_iso(s: SparkSession, d: str) -> DataFrame:
    return _slots_of(v.bookings(s, d)).select("booking_id", timeops.iso_with_offset("start_local").alias("start_iso"))


@query
def compact_utc(s: SparkSession, d: str) -> DataFrame:
    return _slots_of(v.bookings(s, d)).select("booking_id", timeops.compact_utc("start_utc").alias("start_compact"))


@query
def parse_slot(s: SparkSession, d: str) -> DataFrame:
    """ISO text with an offset read back as UTC."""
    text = _slots_of(v.bookings(s, d)).select("booking_id", timeops.iso_with_offset("start_local").alias("t"))
    return text.select("booking_id", timeops.parse_iso("t").alias("start_utc"))


# Availability


@query
def open_slots(s: SparkSession, d: str) -> DataFrame:
    return av.open_slots(v.calendar(s, d), v.busy(s, d)).select("staff_id", "slot_key", "start_utc", "end_utc")


@query
def taken_slots(s: SparkSession, d: str) -> DataFrame:
    return av.taken_slots(v.calendar(s, d), v.busy(s, d)).select("staff_id", "slot_key", "start_utc", "end_utc")


@query
def open_slots_merged(s: SparkSession, d: str) -> DataFrame:
    """The open slots again, by each staff member's busy time as disjoint intervals."""
    return av.open_slots_merged(v.calendar(s, d), v.busy(s, d)).select("staff_id", "slot_key", "start_utc", "end_utc")


@query
def merged_busy(s: SparkSession, d: str) -> DataFrame:
    """The six hours after each click and purchase, and each month after a signup of every eleventh staff member, as disjoint intervals."""
    e = v.read(s, d, "events").filter("event_type in ('click', 'purchase') or event_type = 'signup' and user_id % 11 = 0")
    span = F.when(F.col("event_type") == "signup", F.expr("INTERVAL 30 DAYS")).otherwise(F.expr("INTERVAL 6 HOURS"))
    return av.merged_busy(e.select(F.col("user_id").alias("staff_id"), F.col("ts").alias("busy_start"), (F.col("ts") + span).alias("busy_end")))


def _available(s: SparkSession, d: str) -> DataFrame:
    return av.availability(v.calendar(s, d), v.busy(s, d), v.checks(s, d))


@query
def slot_availability(s: SparkSession, d: str) -> DataFrame:
    return _available(s, d).select("staff_id", "start_utc", "slot_no", "available", "availability_known", "offered")


@query
def slot_fallback(s: SparkSession, d: str) -> DataFrame:
    return av.with_fallback(_available(s, d)).select("staff_id", "start_utc", "slot_no", "offered", "fallback")


@query
def any_open(s: SparkSession, d: str) -> DataFrame:
    return av.any_open(_available(s, d))


@query
def open_labels(s: SparkSession, d: str) -> DataFrame:
    return av.open_labels(_available(s, d)).select("staff_id", F.array_join("labels", "; ").alias("labels"))


@query
def availability_map(s: SparkSession, d: str) -> DataFrame:
    entries = F.map_entries("slots")
    text = F.transform(entries, lambda e: F.concat(timeops.compact_utc(e.key), F.lit("="), e.value.offered.cast("string")))
    return av.availability_map(_available(s, d)).select("staff_id", F.size("slots").alias("n_slots"), F.array_join(F.array_sort(text), ";").alias("slots"))


@query
def freebusy_json(s: SparkSession, d: str) -> DataFrame:
    """Free/busy answers, landed as JSON, as busy intervals."""
    return landed_json.busy_intervals(landed_json.freebusy(v.landed_freebusy(s, d)))


@query
def busy_count(s: SparkSession, d: str) -> DataFrame:
    return landed_json.freebusy(v.landed_freebusy(s, d)).select("staff_id", "calendar_known", "n_busy", (F.col("n_busy") == 0).alias("free"))


@query
def freebusy_request(s: SparkSession, d: str) -> DataFrame:
    return out.freebusy_request(v.calendar(s, d))


# Bookings


@query
def scan_bookings(s: SparkSession, d: str) -> DataFrame:
    """The bookings, written as the CSV log and read back by name, files in parts."""
    text = v.bookings(s, d).select(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created_utc"), "name", "email", F.col("slot_key").alias("slot_label"), F.concat("message", F.lit(",\n"), F.col("booking_id").cast("string")).alias("message"), "event_link")
    path = new_path(s, "bookings")
    bookings_csv.write(text, path)
    back = split_csv.scan(s, path)
    return back.select(timeops.parse_iso("created_utc").alias("created"), "name", or_default("email", "").alias("email"), "slot_label", "message", or_default("event_link", "").alias("event_link"))


@query
def scan_headers(s: SparkSession, d: str) -> DataFrame:
    """The bookings, written as a folder of CSV files with three headers, in one scan that splits files."""
    rows, path = v.bookings(s, d), new_path(s, "bookings")
    text = rows.select(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created_utc"), "name", "email", F.col("slot_key").alias("slot_label"), F.concat("message", F.lit(",\n"), F.col("booking_id").cast("string")).alias("message"), "event_link", "status", "meet_link", "booking_id")
    for k, columns in enumerate((["created_utc", "name", "email", "message"], ["status", "message", "created_utc", "name", "event_link"], ["name", "created_utc", "meet_link", "message", "status", "slot_label"])):
        bookings_csv.write(text.filter(F.col("booking_id") % 3 == k).select(*columns), path)
    back = split_csv.scan(s, path)
    return back.select(timeops.parse_iso("created_utc").alias("created"), "name", "message", *[or_default(c, "").alias(c) for c in ("email", "event_link", "meet_link", "slot_label", "status")])


@query
def status_filter(s: SparkSession, d: str) -> DataFrame:
    return bk.status_filter(v.bookings(s, d), "pending").select("booking_id", "status")


@query
def distinct_status(s: SparkSession, d: str) -> DataFrame:
    return bk.distinct_status(v.bookings(s, d))


@query
def status_options(s: SparkSession, d: str) -> DataFrame:
    return bk.status_options(v.bookings(s, d))


@query
def status_funnel(s: SparkSession, d: str) -> DataFrame:
    return bk.status_funnel(v.bookings(s, d))


@query
def get_default(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", F.coalesce("email", F.lit("-")).alias("email"), F.coalesce("meet_link", F.lit("")).alias("meet_link"))


@query
def param_default(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", or_default("email", OFFICE).alias("reply_to"))


@query
def has_link(s: SparkSession, d: str) -> DataFrame:
    return bk.has_link(v.bookings(s, d)).select("booking_id", "event_link")


@query
def needs_event(s: SparkSession, d: str) -> DataFrame:
    return bk.needs_event(v.bookings(s, d)).select("booking_id")


@query
def review_rows(s: SparkSession, d: str) -> DataFrame:
    return bk.review_rows(v.bookings(s, d))


@query
def review_numbered(s: SparkSession, d: str) -> DataFrame:
    return bk.numbered(v.bookings(s, d)).select("booking_id", "status", "number")


@query
def review_list(s: SparkSession, d: str) -> DataFrame:
    """Numbers over the whole list of pending bookings."""
    return bk.numbered_list(v.bookings(s, d), "pending").select("booking_id", "number")


@query
def label_to_key(s: SparkSession, d: str) -> DataFrame:
    """A map from label to key, looked up for each slot that is offered."""
    pairs = F.create_map(*[F.lit(x) for row in SLOT_OPTIONS for x in (row[2], row[1])])
    return v.calendar(s, d).select("staff_id", "week", "slot_no", F.try_element_at(pairs, "label").alias("slot_key"))


@query
def append_union(s: SparkSession, d: str) -> DataFrame:
    """The bookings and those that came in by the event log (its signups), one behind the other, with what each is from."""
    old = v.bookings(s, d).select("booking_id", "created", F.lit("bookings").alias("origin"))
    new = v.read(s, d, "events").filter("event_type = 'signup'").select("event_id", "ts", F.lit("events"))
    return old.union(new)


@query
def union_by_name(s: SparkSession, d: str) -> DataFrame:
    """Rows without the late columns and rows that have them, in another order."""
    rows = v.bookings(s, d)
    early = rows.filter("booking_id % 2 = 0").select("booking_id", "name")
    late = rows.filter("booking_id % 2 = 1").select("status", "name", "booking_id")
    return early.unionByName(late, allowMissingColumns=True)


@query
def append_log(s: SparkSession, d: str) -> DataFrame:
    """The typed log after two appends, read back: bookings and days of each intake year."""
    rows, path = v.bookings(s, d).select("booking_id", F.col("created").alias("created_utc")), new_path(s, "log")
    for part in ("booking_id % 2 = 0", "booking_id % 2 = 1"):
        bookings_csv.append_parquet(rows.filter(part), path)
    back = bookings_csv.read_log(s, path, rows.schema).groupBy(F.year("intake_date").alias("year"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("intake_date").alias("n_days"), F.max("booking_id").alias("last_id"))


@query
def rewrite_log(s: SparkSession, d: str) -> DataFrame:
    """Two header versions rewritten as one, with the union of their columns, in a new folder."""
    rows, path = v.bookings(s, d), new_path(s, "log-version")
    early = rows.filter("booking_id % 2 = 0").select("booking_id", "name")
    late = rows.filter("booking_id % 2 = 1").select("status", "name", "booking_id", "meet_link")
    bookings_csv.rewrite_parquet([early, late], path)
    return s.read.parquet(path)


@query
def truncate_log(s: SparkSession, d: str) -> DataFrame:
    """How many rows and columns a log has before and after it is truncated."""
    path = new_path(s, "log")
    rows = v.bookings(s, d).select("booking_id", "created", "name")
    rows.write.parquet(path)
    before = s.read.parquet(path).agg(F.count(F.lit(1)).alias("n_before")).first().n_before
    bookings_csv.truncate_parquet(s, rows.schema, path)
    after = s.read.parquet(path)
    return after.agg(F.count(F.lit(1)).alias("n_after")).select(F.lit(before).cast("long").alias("n_before"), "n_after", F.lit(len(after.columns)).alias("n_columns"))


@query
def apply_updates(s: SparkSession, d: str) -> DataFrame:
    rows = v.bookings(s, d).select("booking_id", "status", "event_link")
    changes = rows.filter("booking_id % 3 = 0").select("booking_id", F.lit("confirmed").alias("status"), F.when(F.col("booking_id") % 2 == 0, F.lit("moved")).alias("event_link"))
    return bk.apply_updates(rows, changes, ["status", "event_link"])


@query
def booking_state(s: SparkSession, d: str) -> DataFrame:
    return bk.booking_state(v.actions(v.read(s, d, "events")))


@query
def booking_state_delta(s: SparkSession, d: str) -> DataFrame:
    """A snapshot of the log up to a day, in buckets of the booking, and what came since."""
    log, path = v.actions(v.read(s, d, "events")), new_path(s, "snapshot")
    before = st.save_by_booking(st.partial_state(log.filter("at < '2024-01-20'")), f"snapshot_{uuid.uuid4().hex}", path, BUCKETS)
    return st.state_of(st.advance(before, log.filter("at >= '2024-01-20'")))


@query
def booking_state_bucketed(s: SparkSession, d: str) -> DataFrame:
    """The fold over a log in buckets of the booking, without an exchange."""
    log = st.save_by_booking(v.actions(v.read(s, d, "events")), f"log_{uuid.uuid4().hex}", new_path(s, "log"), BUCKETS)
    return bk.booking_state(log)


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path + "*")


@query
def booking_state_stream(s: SparkSession, d: str) -> DataFrame:
    """The same fold on a file stream of the action log; a batch stores the bookings that it changed."""
    sink = new_path(s, "state")
    intake.store_changes(intake.running_state(v.actions(_event_stream(s, d))), sink, new_path(s, "state-checkpoint")).awaitTermination()
    return versions.latest(s, sink, "booking_id", STATE)


@query
def booking_state_versions(s: SparkSession, d: str) -> DataFrame:
    """The stream stopped after a part of the log, its versions compacted, and taken up again."""
    events, log, sink, checkpoint = v.read(s, d, "events"), new_path(s, "log"), new_path(s, "state"), new_path(s, "state-checkpoint")
    for part in ("event_id % 3 > 0", "event_id % 3 = 0"):
        events.filter(part).write.mode("append").parquet(log)
        stream = v.actions(s.readStream.schema(events.schema).parquet(log))
        intake.store_changes(intake.running_state(stream), sink, checkpoint).awaitTermination()
        if part == "event_id % 3 > 0":
            versions.compact(s, sink, "booking_id", STATE)
    return versions.latest(s, sink, "booking_id", STATE)


@query
def intake_stream(s: SparkSession, d: str) -> DataFrame:
    """Every record delivered twice, kept once."""
    twice = v.actions(_event_stream(s, d)).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    sink = new_path(s, "intake")
    intake.drain(intake.without_redelivered(twice, "action_id", delay="60 days"), sink, new_path(s, "intake-checkpoint"))
    return s.read.parquet(sink).select("action_id", "booking_id", "action")


@query
def intake_log(s: SparkSession, d: str) -> DataFrame:
    """The later half of the log, then all of it, twice; every seventh record has no id. Each is stored once."""
    events, landed, log, checkpoint = v.read(s, d, "events"), new_path(s, "landed"), new_path(s, "intake"), new_path(s, "intake-checkpoint")
    for part in ("ts >= '2024-01-15'", "true"):
        events.filter(part).write.mode("append").parquet(landed)
        rows = v.actions(s.readStream.schema(events.schema).parquet(landed)).withColumn("action_id", F.expr("if(action_id % 7 = 0, null, action_id)"))
        twice = rows.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
        intake.store_intake(twice, log, checkpoint, "action_id").awaitTermination()
    return intake.stored(s, log, twice.schema).select("action_id", "booking_id", "action")


@query
def answered_requests(s: SparkSession, d: str) -> DataFrame:
    """Each click asks, and views of the same booking within twelve hours answer; a row far ahead moves both watermarks past the last request."""
    events, log, sink, checkpoint = v.read(s, d, "events"), new_path(s, "asked"), new_path(s, "answered"), new_path(s, "answered-checkpoint")
    last = events.agg(F.coalesce(F.max("ts"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    ahead = last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("event_type"))
    for part in (events, ahead):
        part.select("event_id", "ts", "user_id", "event_type").write.mode("append").parquet(log)
        rows = s.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(log)
        rows = rows.withColumn("booking_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
        requests = rows.filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), "booking_id", F.col("ts").alias("asked_at"))
        answers = rows.filter("event_type = 'view'").select("booking_id", F.col("event_id").alias("answer_id"), F.col("ts").alias("answered_at"))
        intake.drain(intake.answered(requests, answers, "12 hours"), sink, checkpoint)
    return s.read.parquet(sink).filter("request_id >= 0").select("request_id", "booking_id", "answer_id")


@query
def dedup_bookings(s: SparkSession, d: str) -> DataFrame:
    rows = v.actions(v.read(s, d, "events"))
    return bk.dedup_bookings(rows, ["booking_id"], "at", "action_id").select("booking_id", "action_id", "event_link")


@query
def collapse_bookings(s: SparkSession, d: str) -> DataFrame:
    """A booking written twice, by name, email and slot, is one; the row with a link stays."""
    rows = _slots_of(v.bookings(s, d)).withColumn("slot_local_start", F.col("start_local"))
    kept = bk.dedup_bookings(rows, ["name", "email", "slot_local_start"], "created", "booking_id")
    return kept.select("name", "email", "slot_local_start", "booking_id", "event_link")


@query
def double_bookings(s: SparkSession, d: str) -> DataFrame:
    """Overlaps among the 30 minutes after each click and purchase; other events book nothing."""
    e = v.read(s, d, "events").filter("event_type in ('click', 'purchase')")
    rows = e.select(F.col("user_id").alias("staff_id"), F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end"))
    return bk.double_bookings(rows)


# Catalogue


@query
def catalogue_search(s: SparkSession, d: str) -> DataFrame:
    return cat.search(v.catalogue(s, d), TERM).select("id", "title", "summary")


@query
def program_lookup(s: SparkSession, d: str) -> DataFrame:
    """What is booked of one catalogue entry, found by its id."""
    one = cat.lookup(v.catalogue(s, d), 7).select("id", "title")
    lines = v.read(s, d, "lineitem").filter("l_partkey = 7").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return one.join(lines, one.id == lines.l_partkey, "left").select("id", "title", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query
def selected_detail(s: SparkSession, d: str) -> DataFrame:
    picked = v.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("program_id"))
    return cat.selected_detail(picked, v.catalogue(s, d))


@query
def has_courses(s: SparkSession, d: str) -> DataFrame:
    return v.catalogue(s, d).filter(cat.has_courses()).select("id", F.size("courses").alias("n_courses"))


@query
def default_choice(s: SparkSession, d: str) -> DataFrame:
    rows = v.catalogue(s, d).withColumn("choice", F.when(F.col("id") % 3 == 0, F.col("summary")).when(F.col("id") % 3 == 1, F.lit("")))
    chosen, place = cat.default_choice("choice")
    return rows.select("id", chosen.alias("chosen"), place.alias("place"))


@query
def assign_instructor(s: SparkSession, d: str) -> DataFrame:
    return v.catalogue(s, d).select("id", cat.instructor("brand", ("Brand#11", "Brand#12"), "staff_a", "staff_b").alias("instructor"))


@query
def staff_email(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", cat.staff_email("name", "customer 1", "a@example.com", "b@example.com").alias("staff_email"))


@query
def course_branch(s: SparkSession, d: str) -> DataFrame:
    return v.catalogue(s, d).select("id", cat.course_branch("brand", "Brand#11", "Brand#1").alias("branch"))


@query
def inquiry_text(s: SparkSession, d: str) -> DataFrame:
    rows = v.catalogue(s, d).withColumn("course", F.get("courses", F.lit(0)))
    return rows.select("id", cat.inquiry_text().alias("inquiry"))


@query
def round_robin(s: SparkSession, d: str) -> DataFrame:
    return cat.round_robin(v.catalogue(s, d), "brand", "id", "title").select("id", "bucket")


# Outreach


@query
def message_body(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", out.message_body().alias("body"))


@query
def outreach_feed(s: SparkSession, d: str) -> DataFrame:
    return out.outreach_feed(v.bookings(s, d))


@query
def url_quoted(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", url_quote(F.concat("message", F.lit(" ~*/+é"))).alias("quoted"))


@query
def calendar_link(s: SparkSession, d: str) -> DataFrame:
    rows = _slots_of(v.bookings(s, d))
    return rows.select("booking_id", out.calendar_link("name", "start_utc", "end_utc", "message").alias("link"))


@query
def request_ids(s: SparkSession, d: str) -> DataFrame:
    return v.bookings(s, d).select("booking_id", request_id("name", "email", "slot_key").alias("request_id"))


@query
def event_links(s: SparkSession, d: str) -> DataFrame:
    link, meet = landed_json.event_links("payload")
    return v.landed_events(s, d).select("event_id", link.alias("event_link"), meet.alias("meet_link"))


@query
def event_request(s: SparkSession, d: str) -> DataFrame:
    """Requests for every booking, to the office alone."""
    return out.event_request(_slots_of(v.bookings(s, d)), OFFICE, attend=False)


@query
def event_requests(s: SparkSession, d: str) -> DataFrame:
    return out.event_requests(_slots_of(v.bookings(s, d)), OFFICE)


@query
def merge_responses(s: SparkSession, d: str) -> DataFrame:
    """The state by all actions but views, which stand for the calendar's answers here and are merged as such."""
    rows = bk.booking_state(v.actions(v.read(s, d, "events").filter("event_type <> 'view'"))).drop("confirmed_utc", "email_sent_utc")
    return out.merge_responses(rows, v.landed_events(s, d))


@query
def linked_share(s: SparkSession, d: str) -> DataFrame:
    """Bookings and linked bookings of each day."""
    rows = v.bookings(s, d).groupBy(F.to_date("created").cast("string").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(filled("event_link")).alias("n_linked"))
