from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from slotline.functions import timeops
from slotline.functions.text import matches, or_default, status_of, url_quote


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


@pytest.mark.parametrize("weekday", range(7))
def test_next_weekday_is_strictly_after(spark, weekday):
    days = spark.range(14).select(F.date_add(F.lit(date(2025, 12, 1)), F.col("id").cast("int")).alias("d"))
    for r in days.select("d", timeops.next_weekday("d", weekday).alias("n")).collect():
        assert 1 <= (r.n - r.d).days <= 7 and r.n.weekday() == weekday


def test_sunday_on_a_sunday(spark):
    assert one(spark, timeops.next_weekday("d", 6), d=date(2025, 12, 7)) == date(2025, 12, 14)


def test_golden_slot(spark):
    start = timeops.at_time(timeops.next_weekday("d", 6), F.lit(15), F.lit(0))
    row = spark.createDataFrame([(date(2025, 12, 1),)], ["d"]).select(
        start.alias("start"), timeops.slot_end(start).alias("end"), timeops.iso_with_offset(start).alias("iso"), timeops.compact_utc(timeops.to_utc(start)).alias("utc")
    ).first()
    assert row.start == datetime(2025, 12, 7, 15) and row.end == datetime(2025, 12, 7, 15, 30)
    assert row.iso == "2025-12-07T15:00:00-06:00" and row.utc == "20251207T210000Z"


def test_summer_time(spark):
    assert one(spark, timeops.to_utc(F.col("t").cast("timestamp_ntz")), t="2025-07-05 18:00:00") == datetime(2025, 7, 5, 23)


@pytest.mark.parametrize(("text", "utc"), [("2025-12-07T15:00:00-06:00", datetime(2025, 12, 7, 21)), ("2025-12-01T06:08:19.650101", datetime(2025, 12, 1, 6, 8, 19, 650101)), ("2025-12-01T06:08:19", datetime(2025, 12, 1, 6, 8, 19)), ("soon", None)])
def test_parse_iso(spark, text, utc):
    assert one(spark, timeops.parse_iso("t"), t=text) == utc


@pytest.mark.parametrize(("raw", "status"), [("", "pending"), ("  ", "pending"), ("confirmed", "confirmed")])
def test_status(spark, raw, status):
    assert one(spark, status_of(), status=raw) == status


def test_null_status(spark):
    assert spark.sql("select cast(null as string) as status").select(status_of().alias("x")).first().x == "pending"


@pytest.mark.parametrize(("q", "hit"), [("ab", True), ("CD", True), ("bc", True), ("", True), ("%", False), ("_", False), ("ad", False)])
def test_search_straddles_and_is_literal(spark, q, hit):
    assert one(spark, matches(q, "title", "summary"), title="xAb", summary="cdy") is hit


def test_url_quote(spark):
    from urllib.parse import quote

    text = "a b/c~d*e+f&g\"h\ni=é"
    assert one(spark, url_quote("t"), t=text) == quote(text)


def test_or_default(spark):
    assert one(spark, or_default("t", "x"), t="") == "x" and one(spark, or_default("t", "x"), t="y") == "y"
