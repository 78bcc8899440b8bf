"""Transactions, caches, backups, logs and consistency checks as DataFrame operations."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.hashes import crc32
from lodestar.registry import query, table

#: Share of the limit that an eviction leaves, and backups that are kept.
LEFT, BACKUPS = 0.8, 10


def apply_log(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The state after a log (txn, seq, op, key, value) of put, delete, commit and abort: of each key the last put of a
    committed transaction, unless a later committed delete took it away."""
    done = log.filter("op = 'commit'").select("txn").distinct()
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    changes = log.filter("op IN ('put', 'delete')").join(done, "txn", "left_semi")
    return changes.withColumn("__r", last).filter("__r = 1 AND op = 'put'").select(key, "value")


def states(log: DataFrame) -> DataFrame:
    """(txn, state) by the last operation of each: committed, aborted or active."""
    return log.groupBy("txn").agg(F.max_by("op", "seq").alias("op")).select("txn", F.when(F.col("op") == "commit", "committed").when(F.col("op") == "abort", "aborted").otherwise("active").alias("state"))


_LOG = """WITH lg AS (SELECT user_id % 40 AS txn, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op, user_id % 97 AS key, round(value, 4) AS value FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT t, 1000000000 + t, CASE WHEN t % 4 = 0 THEN 'abort' ELSE 'commit' END, NULL, NULL FROM (SELECT DISTINCT user_id % 40 AS t FROM events) WHERE t % 5 <> 0)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations of forty transactions, most of which commit, some of which abort or stay open."""
    events = table(spark, sf_dir, "events")
    ops = events.filter("event_id % 50 <> 0").select((F.col("user_id") % 40).alias("txn"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), (F.col("user_id") % 97).alias("key"), F.round("value", 4).alias("value"))
    t = F.col("txn")
    ends = events.select((F.col("user_id") % 40).alias("txn")).distinct().filter("txn % 5 <> 0").select("txn", (F.lit(1_000_000_000) + t).alias("seq"), F.when(t % 4 == 0, "abort").otherwise("commit").alias("op"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"))
    return ops.unionByName(ends)


@query(_LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM lg WHERE op IN ('put', 'delete') AND txn IN (SELECT txn FROM lg WHERE op = 'commit')) SELECT key, value FROM r WHERE r = 1 AND op = 'put'")
def txn_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_log(_log(spark, sf_dir))


@query(_LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY txn ORDER BY seq DESC) AS r FROM lg) SELECT txn, CASE op WHEN 'commit' THEN 'committed' WHEN 'abort' THEN 'aborted' ELSE 'active' END AS state FROM r WHERE r = 1")
def txn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(_log(spark, sf_dir))


def evict(entries: DataFrame, limit: int, now: str) -> DataFrame:
    """What stays of a cache (key, hits, used_at): at `limit` entries or fewer all, else the best LEFT of the limit by
    hits per second since the last use. The number that stays is the feature, so it is a sort with a limit."""
    n = entries.count()
    if n <= limit:
        return entries
    age = F.greatest(F.lit(1), F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("used_at").cast("timestamp")))
    return entries.orderBy((F.col("hits") / age).desc(), "key").limit(int(limit * LEFT))


@query("""WITH c AS (SELECT user_id AS key, count(*) AS hits, max(ts) AS used_at FROM events GROUP BY user_id)
SELECT key, hits FROM c ORDER BY hits / greatest(1, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(used_at))::BIGINT) DESC, key LIMIT CASE WHEN (SELECT count(*) FROM c) <= 100 THEN 1000000 ELSE 80 END""")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("hits"), F.max("ts").alias("used_at"))
    return evict(cache, 100, "2024-02-01").select("key", "hits")


def live(entries: DataFrame, now: str, seconds: int = 3600) -> DataFrame:
    """Entries (created_at) that are not older than their time to live."""
    return entries.filter(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")) <= seconds)


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT - floor(epoch(ts))::BIGINT <= 3600")
def cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(table(spark, sf_dir, "events").withColumnRenamed("ts", "created_at"), "2024-01-15 12:00:00").select("event_id")


@query("SELECT s_nationkey AS grp, s_suppkey AS id, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three of each group, as a retention would keep them."""
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("id"), rank.alias("r")).filter("r <= 3")


@query("""WITH a AS (SELECT source, count(*) AS stored FROM documents GROUP BY source), b AS (SELECT source, count(*) AS counted FROM documents WHERE doc_id % 100 <> 7 GROUP BY source)
SELECT coalesce(a.source, b.source) AS source, coalesce(stored, 0) AS stored, coalesce(counted, 0) AS counted, coalesce(stored, 0) = coalesce(counted, 0) AS consistent FROM a FULL OUTER JOIN b ON a.source = b.source""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by group against counts of rows; here the counters miss a hundredth of the documents."""
    docs = table(spark, sf_dir, "documents")
    return consistent(docs.groupBy("source").agg(F.count("*").alias("stored")), docs.filter("doc_id % 100 <> 7").groupBy("source").agg(F.count("*").alias("counted")), "source")


def consistent(stored: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    s, c = F.coalesce("stored", F.lit(0)), F.coalesce("counted", F.lit(0))
    return stored.join(counted, key, "full_outer").select(key, s.alias("stored"), c.alias("counted"), (s == c).alias("consistent"))


def append_log(entries: DataFrame, data: str, order: str) -> DataFrame:
    """entries with crc (CRC-32 of the data) as a log keeps it."""
    return entries.withColumn("crc", F.crc32(F.col(data).cast("binary")))


def checked(log: DataFrame, data: str) -> DataFrame:
    """Entries that still match their CRC, with a flag; damaged ones stay, flagged."""
    return log.withColumn("ok", F.crc32(F.col(data).cast("binary")) == F.col("crc"))


@query("SELECT item_id, md5(text) AS md5, sha256(text) AS sha256 FROM benchmark")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"))


@query(f"SELECT doc_id, crc, true AS ok FROM ({crc32('text', 'documents', 'doc_id')})")
def log_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of every document and whether it matches on reading."""
    return checked(append_log(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id"), "text").select("doc_id", "crc", "ok")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001') OR starts_with(c_name, 'C1')")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix scan; the predicate reaches the Parquet reader."""
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").filter(c.startswith("Customer#0000001") | c.startswith("C1")).select("c_custkey", "c_name")


@query("SELECT event_type AS key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS merges FROM events GROUP BY 1")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum(F.floor("value").cast("long")).alias("total"), F.count("*").alias("merges"))


def backup(df: DataFrame, folder: str, kind: str = "full", since: str | None = None, changed: str | None = None, codec: str = "zstd", keep: int = BACKUPS) -> DataFrame:
    """Write a compressed snapshot (of rows changed since then, if incremental) with a manifest; the manifest row. Of full
    snapshots the newest `keep` stay, with the incremental ones since the oldest of these.

    The checksum is over sorted row hashes, made by a sum that Spark adds up by task, so that it does not depend on files.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(changed) > F.lit(since)) if kind == "incremental" else df
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{folder}/{stamp}-{kind}"
    rows.write.option("compression", codec).parquet(f"{path}/data")
    manifest = {"backup_id": stamp, "kind": kind, "since": since, "path": path, **_fingerprint(spark.read.parquet(f"{path}/data"))}
    out = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    out.coalesce(1).write.text(f"{path}/manifest")
    retain(spark, folder, keep)
    return spark.read.json(f"{path}/manifest")


def _fingerprint(df: DataFrame) -> dict:
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")).first()
    return {"rows": r["rows"], "checksum": r["checksum"]}


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests, newest first."""
    return spark.read.json(f"{folder}/*/manifest").orderBy(F.col("backup_id").desc())


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def verify(spark: SparkSession, path: str) -> bool:
    m = spark.read.json(f"{path}/manifest").first()
    found = _fingerprint(restore(spark, path))
    return (m["rows"], m["checksum"]) == (found["rows"], found["checksum"])


def delete_backup(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def retain(spark: SparkSession, folder: str, keep: int = BACKUPS) -> None:
    """Deletes full backups beyond the newest `keep`, and what is older than the oldest of these."""
    found = backups(spark, folder).select("backup_id", "kind", "path").collect()  # a row for each backup
    full = [r.backup_id for r in found if r.kind == "full"]
    if len(full) > keep:
        for r in found:
            if r.backup_id < full[keep - 1]:
                delete_backup(spark, r.path)
