from datetime import datetime

import pytest

from slotline.functions.timeops import parse_iso
from slotline.sources import bookings_csv, landed_json, scratch

HEAD = "created_utc,name,email,slot_label,slot_local_start,slot_local_end,message,event_link,meet_link"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_missing_and_empty(spark, tmp_path):
    assert bookings_csv.scan(spark, str(tmp_path / "none.csv")).count() == 0
    assert bookings_csv.scan(spark, put(tmp_path, "zero.csv", "")).count() == 0


def test_quotes_and_lines(spark, tmp_path):
    row = bookings_csv.scan(spark, put(tmp_path, "a.csv", f'{HEAD}\n1,n,e,l,s,t,"a, ""b""\nc",x,y\n')).first()
    assert row.message == 'a, "b"\nc' and row.status is None


def test_short_rows_and_header_order(spark, tmp_path):
    short = put(tmp_path, "b.csv", f"{HEAD},email_sent_utc,status,confirmed_utc\n1,n,e,l,s,t,m,x,y\n2,n,e,l,s,t,m,x,y,at,confirmed,then\n")
    got = {r.created_utc: r for r in bookings_csv.scan(spark, short).collect()}
    assert got["1"].status is None and got["2"].status == "confirmed" and got["2"].email_sent_utc == "at" and got["2"].confirmed_utc == "then"
    both = bookings_csv.scan_versions(spark, [short, put(tmp_path, "c.csv", f"{HEAD}\n3,n,e,l,s,t,m,x,y\n")])
    assert both.count() == 3 and both.columns == bookings_csv.SCHEMA.names


def test_typed_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("2025-12-01", "a")], ["created_utc", "name"])
    bookings_csv.append_parquet(rows, path)
    bookings_csv.append_parquet(rows, path)
    assert spark.read.parquet(path).count() == 2
    bookings_csv.truncate_parquet(spark, rows.schema, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == rows.columns


def test_event_links(spark):
    two = '{"htmlLink":"h","conferenceData":{"entryPoints":[{"entryPointType":"video","uri":"1"},{"entryPointType":"phone","uri":"2"},{"entryPointType":"video","uri":"3"}]}}'
    phone = '{"htmlLink":"h","conferenceData":{"entryPoints":[{"entryPointType":"phone","uri":"2"}]}}'
    df = spark.createDataFrame([(two,), (phone,), ('{"htmlLink":"h"}',), ("{}",)], ["payload"])
    link, meet = landed_json.event_links("payload")
    assert [tuple(r) for r in df.select(link.alias("a"), meet.alias("b")).collect()] == [("h", "3"), ("h", None), ("h", None), (None, None)]


def test_freebusy(spark):
    f1 = '{"calendars":{"a":{"busy":[{"start":"2025-12-07T21:00:00Z","end":"2025-12-07T21:10:00Z"}]}}}'
    rows = [("a", True, True, f1), ("b", True, True, '{"calendars":{"b":{"busy":[]}}}'), ("c", True, False, '{"calendars":{"c":{"errors":[{"reason":"x"}]}}}'), ("d", False, True, "{}")]
    got = {r.staff_id: r for r in landed_json.freebusy(spark.createDataFrame(rows, "staff_id string, checked boolean, ok boolean, payload string")).collect()}
    assert {k: (r.n_busy, r.calendar_known) for k, r in got.items()} == {"a": (1, True), "b": (0, True), "c": (0, False), "d": (0, False)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_in_any_session_zone(spark, zone):
    """Texts and landed answers are read as UTC whatever the session's zone, also in the hour that comes twice."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = {"2025-12-07T15:00:00-06:00": datetime(2025, 12, 7, 21), "2025-12-01T06:08:19.650101": datetime(2025, 12, 1, 6, 8, 19, 650101), "2025-11-02T01:30:00-05:00": datetime(2025, 11, 2, 6, 30), "2025-11-02T01:30:00-04:00": datetime(2025, 11, 2, 5, 30), "2025-03-09T02:30:00Z": datetime(2025, 3, 9, 2, 30), "2025-12-01": datetime(2025, 12, 1), "x": None}
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        assert {r.t: r.u for r in df.select("t", parse_iso("t").alias("u")).collect()} == texts
        answer = '{"calendars":{"a":{"busy":[{"start":"2025-11-02T05:30:00.000001Z","end":"2025-11-02T01:30:00-05:00"}]}}}'
        rows = landed_json.busy_intervals(landed_json.freebusy(spark.createDataFrame([("a", True, True, answer)], "staff_id string, checked boolean, ok boolean, payload string")))
        assert [tuple(r) for r in rows.collect()] == [("a", datetime(2025, 11, 2, 5, 30, 0, 1), datetime(2025, 11, 2, 6, 30))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_release(spark):
    """What was put in the shared folder can be removed."""
    df = scratch.kept(spark.range(5), "some")
    assert df.count() == 5 and scratch.release(spark) >= 1
    assert scratch.release(spark) == 0
