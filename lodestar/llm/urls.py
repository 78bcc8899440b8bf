"""URL filters: dated list entries as validity intervals, and an as-of join of captures with them.

A list is a history of entries (pattern, action, day): from that day on the pattern is on the list (add) or off
it (remove). `intervals` turns each pattern's history into half-open intervals [starts, ends) in which it is on
the list; of entries of one day the removal wins. A pattern is a host name; it covers that host and
all hosts below it. `evaluate` gives every capture the entries that were active when it was fetched: the
capture's host and all domains above it, however many, are looked up by equality, and the interval
must hold the fetch day. Captures carry only their key, so no page text moves.

A third of all captures may have one host: the lookup runs on distinct (host, day) pairs first, so a hot
host has at most a row for each day, and results go back to captures by a join in which Spark may split
large partitions, as the other side has one row for each pair.

Defined results: a URL without a host, a null URL and a null day match nothing (blocked false, n_active 0);
a null pattern, action or day in the list is ignored; repeated entries count once; repeated captures give equal
rows; user info, port, case and a final dot of the host are ignored. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Intervals up to which the list is broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.nullif(F.lower(host), F.lit(""))


def names_of(host: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, starts, ends) in which each pattern is on the list; ends is null while it still is."""
    clean = entries.select(F.lower("pattern").alias("pattern"), F.lower("action").alias("action"), "day").na.drop().filter("action IN ('add', 'remove')")
    last = clean.groupBy("pattern", "day").agg(F.max("action").alias("action"))  # 'remove' is the greater
    order = Window.partitionBy("pattern").orderBy("day")
    changes = last.withColumn("was", F.lag("action", 1, "remove").over(order)).filter("action <> was")
    return changes.withColumn("ends", F.lead("day").over(order)).filter("action = 'add'").select("pattern", F.col("day").alias("starts"), "ends")


def evaluate(captures: DataFrame, active: DataFrame, *, key: str, url: str, day: str) -> DataFrame:
    """(key, host, day, blocked, n_active, matched) of each capture; matched: the least active pattern."""
    rows = captures.select(F.col(f"`{key}`").alias("__key"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), F.col(f"`{day}`").alias("day"))
    pairs = rows.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    asked = pairs.withColumn("pattern", F.explode(names_of(F.col("host"))))
    small = active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = (asked["pattern"] == active["pattern"]) & (active["starts"] <= asked["day"]) & (active["ends"].isNull() | (asked["day"] < active["ends"]))
    hits = asked.join(F.broadcast(active) if small else active, on).groupBy(asked["host"], asked["day"]).agg(F.count("*").alias("n_active"), F.min(asked["pattern"]).alias("matched"))
    out = rows.join(hits, ["host", "day"], "left")
    return out.select(F.col("__key").alias(key), "host", "day", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "matched")


#: Of the query: the first day, and how long captures go on.
FIRST_DAY, DAYS = "2024-01-01", 365


def _number(column: str) -> Column:
    return F.conv(F.substring(F.md5(column), 1, 6), 16, 10).cast("int")


def list_history(pages: DataFrame) -> DataFrame:
    """A history for the query, made from the registered domains of the pages by their hash.

    A quarter of them comes onto the list once; of those half goes off after 30 days, and a third comes
    back 60 days after the first.
    """
    domains = pages.select(F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "").alias("pattern")).filter("pattern IS NOT NULL").distinct().withColumn("h", _number("pattern"))
    listed = domains.filter("h % 4 = 0").withColumn("first", F.expr("cast((h div 4) % 300 AS int)"))
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("first")).alias("day")),
        F.when(F.expr("(h div 4) % 2 = 0"), F.struct(F.lit("remove").alias("action"), day(F.col("first") + 30).alias("day"))),
        F.when(F.expr("(h div 4) % 3 = 0"), F.struct(F.lit("add").alias("action"), day(F.col("first") + 60).alias("day"))),
    )
    return listed.select("pattern", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("step")).select("pattern", "step.action", "step.day")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 37 % DAYS).cast("int")))
    return evaluate(captures, intervals(list_history(pages)), key="page_id", url="url", day="day").withColumn("day", F.col("day").cast("string"))


ORACLE_SQL = {
    "op6_urls": """
WITH c AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS DATE) AS day
  FROM pages),
d AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\\.', '') AS pattern FROM c WHERE host IS NOT NULL),
h AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS h FROM d),
l AS (SELECT pattern, h // 4 AS k, (h // 4) % 300 AS first FROM h WHERE h % 4 = 0),
e AS (
  SELECT pattern, 'add' AS action, first AS n FROM l
  UNION ALL SELECT pattern, 'remove', first + 30 FROM l WHERE k % 2 = 0
  UNION ALL SELECT pattern, 'add', first + 60 FROM l WHERE k % 3 = 0),
s AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY pattern ORDER BY n) AS was FROM e),
t AS (SELECT pattern, action, n, lead(n) OVER (PARTITION BY pattern ORDER BY n) AS ends FROM s WHERE action <> was),
i AS (
  SELECT pattern, CAST(DATE '2024-01-01' + CAST(n AS INTEGER) AS DATE) AS starts, CAST(DATE '2024-01-01' + CAST(ends AS INTEGER) AS DATE) AS ends
  FROM t WHERE action = 'add'),
m AS (
  SELECT c.page_id, c.host, c.day, i.pattern
  FROM c LEFT JOIN i ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)) AND i.starts <= c.day AND (i.ends IS NULL OR c.day < i.ends))
SELECT page_id, host, CAST(day AS VARCHAR) AS day, count(pattern) > 0 AS blocked, count(pattern) AS n_active, min(pattern) AS matched
FROM m GROUP BY page_id, host, day"""
}
