"""The run loop as Structured Streaming jobs.

Each job takes streams and gives a stream or starts a query; run() ends one with all that is there (availableNow), as a
scheduled job would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacanta.operators import history
from vacanta.sources import boards
from vacanta.streaming.store import BUCKETS, Store
from vacanta.tables import shared_path, written


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Give every micro-batch to each() and end when all input that is there has been read."""
    path = checkpoint or shared_path(stream.sparkSession, "checkpoint")
    query: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A bounded stream as a table: rows appended by batch, or the last complete result."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    latest = {"batch": -1}

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        latest["batch"] = number

    run(stream, each, mode)
    if latest["batch"] < 0:
        return spark.createDataFrame([], stream.schema)
    table = spark.read.schema(stream.schema).option("basePath", path).parquet(path if mode == "append" else f"{path}/batch={latest['batch']}")
    return table.select(*stream.columns)


def as_utc(c: Column) -> Column:
    """The instant of a time without zone, read as UTC whatever the session's zone."""
    return F.to_timestamp(F.concat(c.cast("string"), F.lit("Z")))


def in_utc(c: Column) -> Column:
    """A time without zone: what a clock in UTC shows at that instant."""
    return F.convert_timezone(None, F.lit("UTC"), c)


def events(spark: SparkSession, folder: str, name: str, watermark: str = "1 day") -> DataFrame:
    """A table of the folder as a stream of files with event time ts."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", as_utc(F.col("ts"))).withWatermark("ts", watermark)


def arriving(rows: DataFrame, order: Column, parts: int, folder: str) -> None:
    """A table as files of a folder that arrive one after another: part i has the rows with order i."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "parts")
    # Dealt once; each part is then read from its own files, so the table is not read anew for every part.
    dealt = rows.withColumn("_part", order.cast("int")).filter(F.col("_part").between(0, parts - 1))
    dealt.write.partitionBy("_part").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    for i in range(parts):
        dealt.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)


def files(spark: SparkSession, folder: str, schema, watermark: str, at: str = "ts") -> DataFrame:
    """A folder of files as a stream, a file at a time in the order of arrival, with event time at."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn(at, as_utc(F.col(at))).withWatermark(at, watermark)


def ended(spark: SparkSession, folder: str, schema, at: str = "ts") -> None:
    """A last file of one row, all null but its time, which lies far ahead: the watermark passes whatever is still open, so it comes out."""
    spark.range(1).select(*(F.lit("9999-01-01 00:00:00" if f.name == at else None).cast(f.dataType).alias(f.name) for f in schema)).coalesce(1).write.mode("append").parquet(folder)


def landed(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Landed payloads as they arrive in a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def ingest(payloads: DataFrame, root: str, screen: Callable[[DataFrame], DataFrame], today: Column, buckets: int = BUCKETS, formats: dict[str, boards.Format] | None = None) -> Store:
    """Parse landed payloads, screen each batch and merge what stays into the roles under root; a batch is a run.

    screen takes the postings of a batch and gives roles with uid, a row for each; the run's number is not known to it. The
    formats are those of boards.parse(). The payloads are parsed as a stream, so that the plan of all formats is made once. The checkpoint is kept under root, beside the
    roles: a batch that is run again after a failure is a run that was merged already, or is merged as if for the first time.
    """
    store = Store(payloads.sparkSession, root, buckets)

    def each(batch: DataFrame, number: int) -> None:
        run_ = number + 1
        if store.current()["run"] >= run_:
            return
        landed_ = written(batch, "postings")
        counts = landed_.groupBy("source_key").agg(F.max("company").alias("company"), F.count("title").alias("n"))
        store.merge(screen(landed_.filter("title IS NOT NULL")), counts, run_, today)

    run(boards.parse(payloads, formats, every=True), each, checkpoint=f"{root}/checkpoint")
    return store


def first_and_last(sightings: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """First and last sighting of each key: two numbers of state a key."""
    return sightings.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def once(sightings: DataFrame, key: str) -> DataFrame:
    """Sightings whose key was not seen within the watermark."""
    return sightings.dropDuplicatesWithinWatermark([key])


def daily_counts(sightings: DataFrame, source: str, at: str = "ts") -> DataFrame:
    """Rows of each source by day; a day comes out once the watermark has passed it."""
    day = sightings.groupBy(F.window(at, "1 day"), source).agg(F.count(F.lit(1)).alias("n"))
    return day.select(source, in_utc(F.col("window.start")).cast("date").alias("day"), "n")


def volume_drops(days: DataFrame, source: str, least: int = 3) -> DataFrame:
    """Of daily counts: sources with at least so many rows on a day and none on the next day that any source has."""
    known = days.select("day").distinct()
    before = days.select(source, F.date_add("day", 1).alias("day"), F.col("n").alias("was"))
    now = before.join(F.broadcast(known), "day").join(days.select(source, "day", "n"), [source, "day"], "left")
    return now.filter((F.col("was") >= least) & F.col("n").isNull()).select(source, "day", "was")


def late_texts(postings: DataFrame, details: DataFrame, key: str, at: str = "ts", within: str = "2 days") -> DataFrame:
    """Postings with the text that arrives up to so long after them, or without once the watermark has passed that."""
    d = details.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col("text").alias("late_text"))
    near = (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(at)) & (F.col("_at") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return postings.join(d, near, "left_outer").drop("_key", "_at")


def last_status(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last status of each key."""
    return changes.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.max(order[0]).alias("updated_at"))


def gone(sightings: DataFrame, key: str, at: str = "ts", days: float = history.LIVE_DAYS) -> DataFrame:
    """key, last_seen and gone_at each time that a key has not been seen for so many days of event time.

    Sightings no further apart than that are one session. A key's state is its open sessions, two numbers each, kept in
    RocksDB and dropped when the watermark reaches their end; seen again, it is live again. The result does not depend on how
    sightings fall into batches as long as none is later than the watermark.
    """
    spark = sightings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gap = f"{int(days * 86_400_000_000)} microseconds"
    open_ = sightings.select(key, at).groupBy(key, F.session_window(at, gap)).agg(F.max(at).alias("last_seen"))
    return open_.select(key, "last_seen", F.col("session_window.end").alias("gone_at"))


def gone_by_the_end(sessions: DataFrame, key: str, delay: str) -> DataFrame:
    """Of all sessions of an input that has ended (gone() over files, the last of them ended()): those whose key is gone.

    That is, those that end no later than the newest sighting less the delay, and those that a later one of their key follows.
    """
    until = sessions.agg((F.max("last_seen") - F.expr(f"INTERVAL {delay}")).alias("until")).scalar()
    # A key has one session of these or, if it was seen again within the delay, two.
    late = sessions.filter(F.col("gone_at") > until).withColumn("_last", F.max("gone_at").over(Window.partitionBy(key)))
    return sessions.filter(F.col("gone_at") <= until).unionByName(late.filter(F.col("gone_at") < F.col("_last")).drop("_last"))
