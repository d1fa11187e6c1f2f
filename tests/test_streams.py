"""The booking streams: restarts, late and nameless records, answers that come too late."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slotline.operators import bookings as bk
from slotline.operators import outreach as out
from slotline.operators import state as st
from slotline.plans import views
from slotline.plans.queries import STATE
from slotline.sources import versions
from slotline.sources.folders import children
from slotline.streaming import intake
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
T = datetime(2025, 1, 10, 12)
ACTION = "action_id long, booking_id long, at timestamp_ntz, action string, event_link string, meet_link string"


def same(a, b):
    return a.select(b.columns).exceptAll(b).isEmpty() and a.count() == b.count()


def test_changed_bookings_only_and_restart(spark, tmp_path):
    """A batch stores what it changed; the latest versions are the fold of all, after restarts, a compaction and a repeated batch."""
    land, sink, checkpoint = (str(tmp_path / x) for x in ("land", "sink", "checkpoint"))
    schema = spark.createDataFrame([], ACTION).schema
    first = [(k, k % 5, T, "created", "", None) for k in range(20)]
    second = [(30, 1, T + timedelta(1), "confirmed", "x", None), (31, None, T, "email_sent", "", "m")]
    third = [(40, 7, T, "created", "", None)]
    log = []
    for n, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, ACTION).write.mode("append").parquet(land)
        log += rows
        intake.store_changes(intake.running_state(spark.readStream.schema(schema).parquet(land)), sink, checkpoint).awaitTermination()
        assert same(versions.latest(spark, sink, "booking_id", STATE), bk.booking_state(spark.createDataFrame(log, ACTION)))
        if n == 1:
            newest = children(spark, sink)[-1]
            assert sorted(r.booking_id or 0 for r in spark.read.parquet(f"{sink}/{newest}").collect()) == [0, 1]
            assert versions.compact(spark, sink, "booking_id", STATE) is not None and len(children(spark, sink)) == 1
            assert versions.compact(spark, sink, "booking_id", STATE) is None
            again = versions.latest(spark, sink, "booking_id", STATE)
            versions.put_version(again.limit(1).withColumn("status", F.lit("old")), sink, int(newest.partition("=")[2]))  # a batch that the base has, once more
            assert same(versions.latest(spark, sink, "booking_id", STATE), again)
    assert versions.latest(spark, str(tmp_path / "none"), "booking_id", STATE).count() == 0


def test_late_and_nameless_records(spark, tmp_path):
    """Every record once, whatever its lateness, with a null id, null time or repeated within and across batches."""
    land, log, checkpoint = (str(tmp_path / x) for x in ("land", "log", "checkpoint"))
    kind = "intake_id string, at timestamp_ntz, name string, email string"
    batches = [
        [("a", T, "n", None), ("a", T, "n", None), (None, T, "n", None), (None, T, "n", None), (None, T, None, "n")],
        [("b", T - timedelta(400), "late", "e"), ("a", T, "n", None), (None, T, "n", None), (None, None, "n", "e")],
        [("b", T - timedelta(400), "late", "e"), (None, None, "n", "e"), ("c", T + timedelta(90), "x", "y")],
    ]
    want = {x for b in batches for x in b}
    for b in batches:
        spark.createDataFrame(b, kind).write.mode("append").parquet(land)
        intake.store_intake(spark.readStream.schema(kind).parquet(land), log, checkpoint).awaitTermination()
    schema = spark.createDataFrame([], kind).schema
    got = [tuple(r) for r in intake.stored(spark, log, schema).collect()]
    assert intake.stored(spark, str(tmp_path / "none"), schema).count() == 0
    assert len(got) == len(want) and set(got) == want


def test_a_batch_that_is_repeated(spark, tmp_path):
    """A batch whose end wasn't recorded finds its own rows in the log."""
    land, log = str(tmp_path / "land"), str(tmp_path / "log")
    kind = "intake_id string, at timestamp_ntz"
    spark.createDataFrame([(str(k), T) for k in range(50)], kind).repartition(3).write.parquet(land)
    for checkpoint in ("one", "two"):  # a new checkpoint delivers all again
        intake.store_intake(spark.readStream.schema(kind).parquet(land), log, str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(log).count() == 50


def test_nameless_records_within_the_delay(spark, tmp_path):
    land, sink = str(tmp_path / "land"), str(tmp_path / "sink")
    kind = "intake_id string, at timestamp_ntz, name string"
    spark.createDataFrame([(None, T, "a"), (None, T, "b"), (None, T, "a"), ("1", T, "a"), ("1", T, "a")], kind).write.parquet(land)
    intake.drain(intake.without_redelivered(spark.readStream.schema(kind).parquet(land)), sink, str(tmp_path / "c"))
    assert sorted(str((r.intake_id, r.name)) for r in spark.read.parquet(sink).collect()) == ["('1', 'a')", "(None, 'a')", "(None, 'b')"]


def test_answers_as_a_stream(spark, tmp_path):
    """Answers within the time are joined, one behind both watermarks isn't, and requests without any come out."""
    asked, said, sink, checkpoint = (str(tmp_path / x) for x in ("asked", "said", "sink", "checkpoint"))
    ask, say = "request_id long, booking_id long, asked_at timestamp_ntz", "booking_id long, answered_at timestamp_ntz, answer_id long"
    hour = timedelta(hours=1)
    steps = [
        ([(1, 10, T), (2, 20, T), (3, 30, T), (4, None, T), (5, 50, T)], [(10, T + hour, 100), (10, T + 2 * hour, 101), (30, T + 30 * hour, 300), (None, T, 400)]),
        ([(-1, -1, T + 100 * hour)], [(-2, T + 100 * hour, -1)]),
        ([(-3, -3, T + 200 * hour)], [(50, T + hour, 500), (-4, T + 200 * hour, -1)]),
        ([(-5, -5, T + 300 * hour)], [(-6, T + 300 * hour, -1)]),
    ]
    for requests, answers in steps:
        spark.createDataFrame(requests, ask).write.mode("append").parquet(asked)
        spark.createDataFrame(answers, say).write.mode("append").parquet(said)
        rows = intake.answered(spark.readStream.schema(ask).parquet(asked), spark.readStream.schema(say).parquet(said), "24 hours")
        intake.drain(rows, sink, checkpoint)
    got = spark.read.parquet(sink).filter("request_id > 0")
    assert sorted((r.request_id, r.answer_id or 0) for r in got.collect()) == [(1, 100), (1, 101), (2, 0), (3, 0), (4, 0), (5, 0)]
    # in time it is the batch join, and merging its answers is merging all answers
    state = spark.createDataFrame([(10, "pending", "", None), (20, "pending", "", None)], "booking_id long, status string, event_link string, meet_link string")
    payload = F.concat(F.lit('{"htmlLink":"h'), F.col("answer_id").cast("string"), F.lit('"}')).alias("payload")
    streamed = got.filter("answer_id is not null").select("booking_id", F.col("answered_at").cast("timestamp_ntz").alias("at"), payload)
    batch = spark.createDataFrame(steps[0][1], say).filter("booking_id <> 30").select("booking_id", F.col("answered_at").alias("at"), payload)
    assert same(out.merge_responses(state, streamed), out.merge_responses(state, batch)) and out.merge_responses(state, streamed).filter("event_link = 'h101'").count() == 1


@pytest.mark.parametrize("parts", [2, 5])
def test_any_split_of_the_log(spark, parts):
    """Snapshots advanced by the rest of a log, and merged parts, are the fold of the whole."""
    log = views.actions(views.read(spark, SF, "events")).unionByName(spark.createDataFrame([(1, None, T, "confirmed", "x", None), (2, None, T + timedelta(1), "email_sent", None, "")], ACTION))
    want = bk.booking_state(log)
    pieces = [log.filter(F.pmod(F.xxhash64("action_id", F.lit(parts)), F.lit(parts)) == k) for k in range(parts)]
    snapshot = st.partial_state(pieces[0])
    for p in pieces[1:]:
        snapshot = st.advance(snapshot, p)
    assert same(st.state_of(snapshot), want)
    assert same(st.state_of(st.merged(*map(st.partial_state, pieces[::-1]))), want)
    assert same(st.state_of(st.advance(st.partial_state(log), log.limit(0))), want) and same(st.state_of(st.advance(st.partial_state(log.limit(0)), log)), want)


def test_buckets_need_no_exchange(spark, tmp_path):
    log = st.save_by_booking(views.actions(views.read(spark, SF, "events")), "test_log", str(tmp_path / "log"), 8)
    try:
        fold = bk.booking_state(log)
        assert "Exchange" not in fold._jdf.queryExecution().executedPlan().toString() and fold.count() > 0
        snapshot = st.save_by_booking(st.partial_state(log), "test_snapshot", str(tmp_path / "snapshot"), 8)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        later = st.advance(snapshot, log.limit(50))
        plan = later._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        joined = plan[plan.index("SortMergeJoin") : plan.index("Union", plan.index("SortMergeJoin")) if "Union" in plan[plan.index("SortMergeJoin") :] else None]
        left = joined[: joined.index("test_snapshot")]
        assert "Exchange" not in left
    finally:
        st.drop_table(spark, "test_log")
        st.drop_table(spark, "test_snapshot")
