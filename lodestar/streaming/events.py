"""Structured Streaming jobs over sync events, query logs and requests, each with its batch twin.

Every stream function takes and returns DataFrames, so it runs on a streaming or a static one; `drain` runs a
stream to the end of what has landed (availableNow) into a table in a folder. Event time has watermarks; late
rows beyond them are dropped by the stream, as the batch twins, which see all rows, have no lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.registry import query, table

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events that land as Parquet files, with ts as a timestamp."""
    found = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run until all that has landed is processed; the result as a table.

    Append goes to Parquet; update keeps the newest row of each key, batch by batch, under a number of its own, so
    that a batch that runs again replaces itself.
    """
    spark = stream.sparkSession
    where = f"{folder}/data"
    if mode == "append":
        job = stream.writeStream.format("parquet").option("path", where).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        job.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(where)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(where).drop("batch")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__batch").desc()))
    return rows.withColumn("__r", last).filter("__r = 1").drop("__r", "__batch")


def as_sync(events: DataFrame) -> DataFrame:
    """Events read as sync events: (event_type, page_id, domain, ts)."""
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "PageUpdated"), ("signup", "PageAdded"), ("error", "PageDeleted"), ("click", "ChunkAdded"), ("purchase", "EmbeddingUpdated")) for x in pair))
    return events.select(F.element_at(kinds, F.col("event_type")).alias("kind"), F.col("user_id").alias("page_id"), (F.col("user_id") % 7).cast("string").alias("domain"), "ts")


def counter_changes(sync: DataFrame) -> DataFrame:
    """(key, delta): total_pages and domain counters by added and deleted pages, chunks by page."""
    step = F.when(F.col("kind") == "PageAdded", 1).when(F.col("kind") == "PageDeleted", -1)
    changes = F.array(
        F.struct(F.lit("total_pages").alias("key"), step.alias("delta")),
        F.struct(F.concat(F.lit("domain_"), "domain").alias("key"), F.when(F.col("kind") == "PageAdded", 1).alias("delta")),
        F.struct(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit("_chunks")).alias("key"), F.when(F.col("kind") == "ChunkAdded", 1).alias("delta")),
    )
    return sync.select(F.explode(changes).alias("c")).select("c.*").filter("delta IS NOT NULL")


def counters(sync: DataFrame) -> DataFrame:
    return counter_changes(sync).groupBy("key").agg(F.sum("delta").alias("value"))


@query("""
WITH s AS (SELECT CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' WHEN 'click' THEN 'C' END AS k, user_id, user_id % 7 AS d FROM events),
c AS (SELECT 'total_pages' AS key, CASE k WHEN 'A' THEN 1 ELSE -1 END AS delta FROM s WHERE k IN ('A', 'D')
  UNION ALL SELECT 'domain_' || d, 1 FROM s WHERE k = 'A' UNION ALL SELECT 'page_' || user_id || '_chunks', 1 FROM s WHERE k = 'C')
SELECT key, CAST(sum(delta) AS BIGINT) AS value FROM c GROUP BY key""")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(as_sync(table(spark, sf_dir, "events")))


def last_updated(sync: DataFrame) -> DataFrame:
    return sync.filter("kind = 'EmbeddingUpdated'").groupBy("page_id").agg(F.max("ts").alias("last_updated"))


@query("SELECT user_id AS page_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_updated FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def sync_last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_updated(as_sync(table(spark, sf_dir, "events"))).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; rows later than `late` are dropped in a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hourly(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("""
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """One row for each key; a stream remembers keys as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


@query("SELECT event_id, user_id, event_type FROM events")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were delivered twice, once each."""
    events = table(spark, sf_dir, "events")
    return without_repeats(events.unionByName(events.filter("event_id % 3 = 0"))).select("event_id", "user_id", "event_type")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type AS query, count(*) AS times FROM events GROUP BY 1, 2")
def query_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity by day of a query log."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("query")).agg(F.count("*").alias("times"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "query", "times")


def throttled(requests: DataFrame, rps: float, burst: int) -> DataFrame:
    """(user_id, event_id, admitted_us) of a stream of requests, by a token bucket of each user as state.

    The state is one number a user and never times out: a replayed stream must not forget a bucket between two of its batches.
    """
    period = int(1_000_000 / rps)

    def admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else None
        # A key's rows come in several Arrow chunks, unsorted: three numbers a row are held to order them all.
        rows = pd.concat(parts).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            out.append(t if due is None else max(t, due - (burst - 1) * period))
            due = max(t, due if due is not None else t) + period
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "admitted_us": out})
        state.update((int(due),))

    rows = requests.select("user_id", "event_id", F.unix_micros("ts").alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(admit, "user_id long, event_id long, admitted_us long", "due long", "append", GroupStateTimeout.NoTimeout)


def index_stream(pages: DataFrame, folder: str, batch_rows: int = 1000) -> dict[str, int]:
    """Write a stream of pages (page_id, html) in micro-batches, rows without text apart; totals of both."""
    spark = pages.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(F.length("html") > 0, F.lit(False))
        batch.withColumn("ok", ok).write.mode("overwrite").option("maxRecordsPerFile", batch_rows).parquet(f"{folder}/data/batch={number}")

    pages.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    r = spark.read.parquet(f"{folder}/data").agg(F.count("*").alias("total"), F.count_if("ok").alias("success")).first()
    return {"total": r.total, "success": r.success, "failed": r.total - r.success}


@query("SELECT CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 100) AS BIGINT) AS batch, page_id FROM pages")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in batches of a hundred by id: ranks come from counts of id ranges (one row each) and ranks inside them."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    return numbered(pages, "page_id").select(F.expr("number div 100").alias("batch"), "page_id")


def numbered(rows: DataFrame, key: str, ranges: int = 4096) -> DataFrame:
    """rows with number, from 0 in key order, without sorting all rows in one task."""
    span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if span.lo is None:
        return rows.withColumn("number", F.lit(0).cast("long"))
    width = (span.hi - span.lo) // ranges + 1
    cut = rows.withColumn("__c", F.expr(f"({key} - {span.lo}L) div {width}L"))
    sizes = cut.groupBy("__c").agg(F.count("*").alias("n"))
    before = sizes.select("__c", (F.sum("n").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__b"))  # at most `ranges` + 1 rows
    inside = F.row_number().over(Window.partitionBy("__c").orderBy(key)) - 1
    return cut.withColumn("__i", inside).join(F.broadcast(before), "__c").withColumn("number", (F.col("__b") + F.col("__i")).cast("long")).drop("__c", "__i", "__b")
