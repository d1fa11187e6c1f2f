from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotline.functions.text import request_id
from slotline.operators import availability as av
from slotline.operators import bookings as bk
from slotline.operators import catalogue as cat
from slotline.operators import outreach as out
from slotline.operators.slots import slot_calendar
from slotline.operators.ordering import number_rows
from slotline.plans import views
from slotline.sources.bookings_csv import append_parquet
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def slots(spark):
    staff = spark.createDataFrame([("a",), ("b",), ("c",)], ["staff_id"])
    return slot_calendar(staff, date(2025, 12, 1), 1).cache()


def busy(spark, *rows):
    return spark.createDataFrame(list(rows), "staff_id string, busy_start timestamp_ntz, busy_end timestamp_ntz")


def test_edges_are_free(spark, slots):
    start = slots.filter("staff_id = 'a' and slot_no = 3").first().start_utc
    touching = busy(spark, ("a", start - timedelta(minutes=30), start), ("a", start + timedelta(minutes=30), start + timedelta(minutes=60)))
    assert av.open_slots(slots, touching).count() == 12
    over = busy(spark, ("a", start - timedelta(minutes=1), start + timedelta(minutes=1)), ("a", start, start + timedelta(minutes=5)))
    assert av.open_slots(slots, over).count() == 11 and av.taken_slots(slots, over).count() == 1


def test_fallback(spark, slots):
    all_day = busy(spark, ("a", datetime(2025, 12, 1), datetime(2025, 12, 30)))
    checks = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True)], ["staff_id", "checked", "ok"])
    rows = av.availability(slots, all_day, checks)
    assert {r.staff_id: r.n for r in rows.groupBy("staff_id").agg(F.count_if("offered").alias("n")).collect()} == {"a": 0, "b": 0, "c": 4}
    got = {r.staff_id: (r.n, r.f) for r in av.with_fallback(rows).groupBy("staff_id").agg(F.count("*").alias("n"), F.bool_or("fallback").alias("f")).collect()}
    assert got == {"a": (4, True), "b": (4, True), "c": (4, False)}


def test_open_and_taken_partition_the_slots(spark):
    c, b = views.calendar(spark, SF), views.busy(spark, SF)
    assert av.open_slots(c, b).count() + av.taken_slots(c, b).count() == c.count()


def test_fold(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, t, "created", "", None), (1, t, "email_sent", "", None), (2, t, "created", "", None), (2, t, "email_marked", "", None), (3, t, "event_created", "x", "m"), (3, t + timedelta(1), "confirmed", "", None)]
    got = {r.booking_id: r for r in bk.booking_state(spark.createDataFrame(rows, "booking_id long, at timestamp_ntz, action string, event_link string, meet_link string")).collect()}
    assert (got[1].status, got[2].status, got[3].status) == ("confirmed", "pending", "confirmed")
    assert got[3].event_link == "x" and got[3].confirmed_utc == t + timedelta(1) and got[2].email_sent_utc == t


def test_links_of_one_time(spark):
    """Of links of one time the last in order of text counts, whatever the order of the rows."""
    t = datetime(2025, 1, 1)
    rows = [(1, t, "event_created", link, None) for link in ("b", "c", "a", "")]
    for own in (rows, rows[::-1]):
        got = bk.booking_state(spark.createDataFrame(own, "booking_id long, at timestamp_ntz, action string, event_link string, meet_link string")).collect()
        assert [(r.event_link, r.meet_link) for r in got] == [("c", None)]


def test_dedup_of_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(None, "1", "x", 1), (None, "1", "x", 3), (None, "1", None, 9), ("a", "2", "", 4)], "name string, created string, event_link string, id int")
    assert sorted(r.id for r in bk.dedup_bookings(rows, ["name"], "created", "id").collect()) == [3, 4]
    assert bk.dedup_bookings(rows.limit(0), ["name"], "created", "id").count() == 0


def test_round_robin_of_a_hot_group(spark):
    """Numbered in chunks as if by one window, with ties, null groups and null numbers."""
    rows = [("a" if k % 9 else None, None if k % 50 == 0 else k % 200, f"t{k % 7}-{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "brand string, id long, title string")
    got = {r.title: r.bucket for r in cat.round_robin(df, "brand", "id", "title", chunk=16).collect()}
    for group in ("a", None):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [k % 3 for k in range(len(own))]


def test_lookup_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (2, "0", "0")], "id int, title string, summary string")
    assert [tuple(r) for r in cat.lookup(df, 1).collect()] == [(1, "a", "y")] and cat.lookup(df, 3).count() == 0


def test_dedup_prefers_the_link_and_repeats_itself(spark):
    rows = spark.createDataFrame([("n", "e", "s", "1", ""), ("n", "e", "s", "2", "x"), ("n", "e", "s", "3", None), ("m", "e", "s", "1", None)], ["name", "email", "slot", "created", "event_link"])
    how = (["name", "email", "slot"], "created", "created")
    once = bk.dedup_bookings(rows, *how)
    assert sorted((r.name, r.created) for r in once.collect()) == [("m", "1"), ("n", "2")]
    assert bk.dedup_bookings(once, *how).count() == 2


def test_double_bookings_equal_the_plain_join(spark):
    e = views.read(spark, SF, "events")
    rows = e.select(F.pmod("user_id", F.lit(3)).alias("staff_id"), F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 47 MINUTES")).alias("end"))
    a, b = rows.alias("a"), rows.alias("b")
    plain = a.join(b, F.expr("a.staff_id = b.staff_id and a.id < b.id and a.start < b.end and b.start < a.end")).count()
    assert bk.double_bookings(rows).count() == plain > 0
    nobody = rows.withColumn("staff_id", F.lit(None).cast("long"))
    assert bk.double_bookings(nobody).count() == 0


def test_outreach_needs_a_recipient(spark):
    rows = spark.createDataFrame([(1, "n", "", "k", None), (2, "n", None, "k", None), (3, "n", "e@x", "k", "m")], "booking_id long, name string, email string, slot_key string, meet_link string")
    got = out.outreach_feed(rows).collect()
    assert [r.booking_id for r in got] == [3] and got[0].body.endswith("Join: m")


def test_merged_busy(spark, slots):
    """Disjoint unions of overlapping, touching, contained, repeated and years-long intervals give the same open slots, with fewer rows to join."""
    t = datetime(2025, 12, 6, 20)
    m = timedelta(minutes=1)
    rows = [("a", t, t + 90 * m), ("a", t + 30 * m, t + 60 * m), ("a", t + 90 * m, t + 91 * m), ("a", t + 200 * m, t + 201 * m), ("a", t + 200 * m, t + 201 * m), ("a", t + 5 * m, t + 5 * m), ("a", t + 9 * m, t), ("b", datetime(2020, 1, 1), datetime(2030, 1, 1)), (None, t, t + m), ("c", t, None)]
    rows += [("c", datetime(2025, 12, 7, 21) + k * m, datetime(2025, 12, 7, 21) + (k + 15) * m) for k in range(300)]
    df = busy(spark, *rows)
    got = sorted((r.staff_id, r.busy_start, r.busy_end) for r in av.merged_busy(df).collect())
    assert got == [("a", t, t + 91 * m), ("a", t + 200 * m, t + 201 * m), ("b", datetime(2020, 1, 1), datetime(2030, 1, 1)), ("c", datetime(2025, 12, 7, 21), datetime(2025, 12, 7, 21) + 314 * m)]
    plain, merged = av.open_slots(slots, df), av.open_slots_merged(slots, df)
    assert sorted(map(str, plain.collect())) == sorted(map(str, merged.collect())) and 0 < plain.count() < 12
    first, last = F.lit("2025-12-06").cast("timestamp_ntz"), F.lit("2025-12-14").cast("timestamp_ntz")
    assert av._by_day(av.merged_busy(df, first, last)).count() < 20 < 3000 < av._by_day(df).count()
    assert av.open_slots_merged(slots, df.limit(0)).count() == 12 and av.open_slots_merged(slots.limit(0), df).count() == 0 and av.merged_busy(df.limit(0)).count() == 0


def test_numbers_over_a_whole_list(spark):
    """As one window gives them, over nulls and over many rows of one day."""
    t = datetime(2025, 1, 1)
    rows = [(k, t if k % 3 else t + timedelta(hours=k % 7), "" if k % 2 else "confirmed") for k in range(3000)] + [(9000, None, None), (None, t, None)]
    df = spark.createDataFrame(rows, "booking_id long, created timestamp_ntz, status string").repartition(7)
    for status in ("pending", "all"):
        listed = bk.status_filter(df, status)
        want = {r.booking_id: r.n for r in listed.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_first("created"), F.asc_nulls_first("booking_id")))).collect()}
        assert {r.booking_id: r.number for r in bk.numbered_list(df, status).collect()} == want
    assert "Window" not in bk.numbered_list(df)._jdf.queryExecution().executedPlan().toString()
    assert bk.numbered_list(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1,)] * 40, "id int").repartition(5)
    assert sorted(r.number for r in number_rows(same, "id").collect()) == list(range(1, 41))


def test_request_ids_do_not_run_together(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", "x"), (None, "x"), ("-", ""), ("1:a", ""), ("1", ":a")], "a string, b string")
    assert rows.select(request_id("a", "b").alias("id")).distinct().count() == 7


def test_files_of_a_day_are_bounded(spark, tmp_path):
    """However many tasks write, a small day is one file for each append."""
    rows = spark.range(2000).select(F.col("id"), (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 3)).alias("created_utc")).repartition(16)
    append_parquet(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2000
    assert all(len(list(d.glob("*.parquet"))) <= 2 for d in (tmp_path / "log").glob("intake_date=*"))


def test_repeated_changes_and_entries(spark):
    """Neither doubles a row, and nulls and empty tables have defined results."""
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "c", "y")], "booking_id long, status string, event_link string")
    changes = spark.createDataFrame([(1, "z", None), (1, "y", "w"), (1, "z", "v"), (9, "q", "q"), (None, "n", "n")], "booking_id long, status string, event_link string")
    got = sorted(map(tuple, bk.apply_updates(rows, changes, ["status", "event_link"]).collect()), key=str)
    assert got == sorted([(1, "z", "v"), (2, "b", "x"), (None, "c", "y")], key=str)
    assert bk.apply_updates(rows.limit(0), changes, ["status"]).count() == 0 and bk.apply_updates(rows, changes.limit(0), ["status"]).count() == 3
    entries = spark.createDataFrame([(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (None, "n", "n")], "id int, title string, summary string")
    picked = spark.createDataFrame([(1,), (1,), (2,), (None,)], "program_id int")
    got = sorted(map(tuple, cat.selected_detail(picked, entries).collect()), key=str)
    assert got == sorted([(1, "a", "y", True), (1, "a", "y", True), (2, None, None, False), (None, None, None, False)], key=str)


def test_answers_of_one_time(spark):
    t = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(1, "pending", "", None)], "booking_id long, status string, event_link string, meet_link string")
    said = spark.createDataFrame([(1, t, '{"htmlLink":"a"}'), (1, t, '{"htmlLink":"b"}'), (1, None, '{"htmlLink":"z"}')], "booking_id long, at timestamp_ntz, payload string")
    assert [(r.event_link, r.status) for r in out.merge_responses(rows, said).collect()] == [("b", "confirmed")]
    assert out.merge_responses(rows, said.limit(0)).first().status == "pending" and out.merge_responses(rows.limit(0), said).count() == 0


def test_numbers_within_days(spark):
    t = datetime(2025, 1, 1)
    rows = [(k, t + timedelta(hours=k % 30), "confirmed" if k % 4 == 0 else "") for k in range(200)] + [(900, None, ""), (901, None, "")]
    df = spark.createDataFrame(rows, "booking_id long, created timestamp_ntz, status string").repartition(5)
    w = Window.partitionBy("status", F.to_date("created")).orderBy("created", "booking_id")
    want = {r.booking_id: r.n for r in bk.with_status(df).withColumn("n", F.row_number().over(w)).collect()}
    assert {r.booking_id: r.number for r in bk.numbered(df).collect()} == want and bk.numbered(df.limit(0)).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clashes_in_any_session_zone(spark, zone):
    """Also in the hours that a zone skips and repeats; nulls are in no pair."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        m = timedelta(minutes=1)
        rows = [("a", 3 * k + j, day + 17 * k * m, day + (17 * k + 40) * m) for j, day in enumerate((datetime(2025, 3, 9, 1), datetime(2025, 11, 2, 0, 30))) for k in range(12)]
        rows = [(s, i + 100 * (t.month == 11), t, u) for s, i, t, u in rows] + [("a", None, datetime(2025, 3, 9, 2), datetime(2025, 3, 9, 3)), ("a", 999, None, datetime(2025, 3, 9, 3)), (None, 998, datetime(2025, 3, 9, 2), datetime(2025, 3, 9, 3))]
        df = spark.createDataFrame(rows, "staff_id string, id long, start timestamp_ntz, end timestamp_ntz")
        good = [r for r in rows if None not in r]
        want = sorted((x[1], y[1]) for x in good for y in good if x[1] < y[1] and x[2] < y[3] and y[2] < x[3])
        assert sorted((r.id_a, r.id_b) for r in bk.double_bookings(df).collect()) == want and want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
