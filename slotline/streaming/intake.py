"""The booking streams: intake without re-delivered records, the running state of bookings, answered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from slotline.operators.bookings import state_aggregates
from slotline.sources.folders import children
from slotline.sources.versions import put_version

NO_DAY = "none"


def record_key(columns: list[str], id_: str) -> Column:
    """What tells records apart: the id, or all fields of a record without one (128 bits of hash, nulls in their places)."""
    fields = [x for c in sorted(columns) for x in (F.col(c), F.col(c).isNull())]
    whole = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *fields)), 16, "0") for seed in (1, 2)])
    return F.coalesce(F.concat(F.lit("id:"), F.col(id_).cast("string")), F.concat(F.lit("fields:"), whole))


def without_redelivered(stream: DataFrame, id_: str = "intake_id", at: str = "at", delay: str = "1 day") -> DataFrame:
    """Each intake record once, however often it is delivered within the delay.

    Records without an id are told apart by all their fields. Records that come later than the
    delay behind the latest one are lost, as Spark drops what is behind the watermark; a stream
    that may not lose any goes through `store_intake`.
    """
    keyed = stream.withColumn("_record", record_key(stream.columns, id_)).withColumn(at, F.col(at).cast("timestamp"))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_record"]).drop("_record")


def store_intake(stream: DataFrame, log: str, checkpoint: str, id_: str = "intake_id", at: str = "at") -> StreamingQuery:
    """Start to append every record once to a stored log, whatever its lateness: all columns, record_key and day.

    A batch is held against the days of the log that it has records of; a record that is
    delivered again has its first time, and so its day. No state grows with the stream, and a
    batch that is repeated after a crash finds its own rows. Rows without a time are of the
    day `none`.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date(at).cast("string"), F.lit(NO_DAY))
        new = batch.withColumn("record_key", record_key(batch.columns, id_)).withColumn("day", day).dropDuplicates(["record_key"]).persist()
        days = [r.day for r in new.select("day").distinct().collect()]
        stored = {n.partition("=")[2] for n in children(spark, log)}
        if stored & set(days):
            old = spark.read.schema(new.schema).parquet(log).filter(F.col("day").isin(days)).select("record_key")
            rows = new.join(old, "record_key", "left_anti")
        else:
            rows = new
        if days:
            rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(log)
        new.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, log: str, schema: StructType) -> DataFrame:
    """The records that `store_intake` has put in a log, in the schema of its stream; none if it has put none."""
    if not children(spark, log):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema, StructField("record_key", StringType()), StructField("day", StringType())])).parquet(log).select(*schema.names)


def running_state(stream: DataFrame) -> DataFrame:
    """The same fold as the batch one; the state is a row for each booking."""
    return stream.groupBy("booking_id").agg(*state_aggregates())


def store_changes(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Start to put, for each batch, the rows that it changed as a version of a keyed table (`versions.latest` reads it)."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: put_version(batch, sink, epoch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answered(requests: DataFrame, answers: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Each request with the answers to its booking that come within a time of it, or with none once no more can come.

    `requests`: request_id, booking_id, asked_at; `answers`: booking_id, answered_at and what
    else they have. Both may be streams: a request without an answer is given out when both
    watermarks, `delay` behind the latest times, are past its limit, and its state is dropped
    then. Answers that come later than that aren't joined. Rows without a time or a booking
    are never answered.
    """
    r = requests.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", delay).alias("r")
    a = answers.withColumnRenamed("booking_id", "_booking").withColumn("answered_at", F.col("answered_at").cast("timestamp")).withWatermark("answered_at", delay).alias("a")
    near = F.expr(f"r.booking_id = a._booking and a.answered_at >= r.asked_at and a.answered_at <= r.asked_at + interval {within}")
    return r.join(a, near, "leftOuter").drop("_booking")


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what is available to a Parquet folder."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
