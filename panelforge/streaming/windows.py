"""Event streams with watermarks that bound their state and leave late events out: tumbling and sliding windows, first arrivals, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.sinks import new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def day_windows(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums by day and event type; events of windows that the watermark has closed are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_windows(spark: SparkSession, stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Run a stream of events to the end of what has arrived: the last state of every window.

    Each micro-batch writes only the windows that it changed, under its own number (a repeated batch replaces
    itself); of a window's rows the one of the latest batch counts. State goes as the watermark passes.
    """
    rows = last_state(spark, day_windows(stream, late))
    return rows.select(F.col("window.start").cast("date").alias("day_"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    return latest_windows(spark, spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time as a timestamp."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def appended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream in append mode to the end of what has arrived. The file sink's log makes each batch count once."""
    out = new_folder(spark, "appended")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def sliding_windows(events: DataFrame, late: str = "2 days", width: str = "3 days", slide: str = "1 day") -> DataFrame:
    """Counts and sums by overlapping windows and event type; an event is in width / slide of them."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key; repeats that come within `late` are left out, and a key's state goes after that."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def followed(events: DataFrame, first: str, then: str, within: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, first_id, then_id): events of kind `then` that follow one of kind `first` of the same user within some time.

    Both sides have watermarks and the times bound each other, so a row's state goes once no partner can come.
    """
    a = events.where(F.col("event_type") == first).select(F.col("user_id").alias("a_user"), F.col("event_id").alias("first_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    b = events.where(F.col("event_type") == then).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    found = a.join(b, F.expr(f"a_user = b_user AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {within}"))
    return found.select(F.col("a_user").alias("user_id"), "first_id", "then_id")


def last_state(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """Run windows (window, event_type, n, total) in update mode; of a window's rows those of its latest batch."""
    out = new_folder(spark, "stream")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/windows/part={batch}")

    windows.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/windows").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return rows.select("window", "event_type", "last.n", "last.total")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days, one a day, over the events."""
    rows = last_state(spark, sliding_windows(_arriving(spark, sf_dir)))
    return rows.select(F.col("window.start").cast("date").alias("start_"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice (the stream and a copy of it), each counted once, by type."""
    twice = _arriving(spark, sf_dir).unionByName(_arriving(spark, sf_dir))
    rows = appended(spark, first_of_each(twice, ["event_id"]).select("event_type", "value", "event_id"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def stream_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within six hours of a click of the same user."""
    return appended(spark, followed(_arriving(spark, sf_dir), "click", "purchase"))


#: name -> (job, SQL of the same over the whole table at once)
QUERIES = {
    "generic_stream_sliding": (stream_sliding, """SELECT CAST(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS DATE) AS start_, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(3) r(k) GROUP BY 1, event_type"""),
    "generic_stream_first": (stream_first, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type"),
    "generic_stream_followed": (stream_followed, """SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'"""),
}
