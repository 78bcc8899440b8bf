"""Crawl policies: robots rules, frontier search by levels, token buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.pages import host
from lodestar.registry import query, shared_folder, table


@dataclass(frozen=True)
class Politeness:
    """Requests a second and burst."""

    rps: float = 2.0
    burst: int = 5


# Presets.
DEFAULT, AGGRESSIVE, POLITE = Politeness(2.0, 5), Politeness(10.0, 20), Politeness(0.5, 1)


def robots_rules(texts: DataFrame, agent: str = "*", union: bool = False) -> DataFrame:
    """(host, allow, disallow, crawl_delay, sitemap) from (host, text).

    Rules come from the groups that name the agent, else from those of *; with `union` from both. Lines of
    several user agents in a row form one group. The last sitemap counts, in whichever group it stands.
    """
    lines = texts.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    clean = lines.select("host", "no", F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).filter("line LIKE '%:%'")
    field = clean.select("host", "no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, locate(':', line) + 1)")).alias("value"))
    order = Window.partitionBy("host").orderBy("no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    grouped = field.withColumn("grp", F.sum(starts.cast("int")).over(order))
    own = grouped.filter(is_agent).groupBy("host", "grp").agg(F.max((F.lower("value") == agent.lower()).cast("int")).alias("named"), F.max((F.col("value") == "*").cast("int")).alias("any"))
    best = own.withColumn("has", F.max("named").over(Window.partitionBy("host")))
    chosen = best.filter((F.col("named") == 1) | ((F.col("any") == 1) & (F.lit(union) | (F.col("has") == 0)))).select("host", "grp", F.lit(1).alias("mine"))
    rows = grouped.join(chosen, ["host", "grp"], "left")
    rule = lambda name: F.transform(F.array_sort(F.collect_list(F.when((F.col("mine") == 1) & (F.col("field") == name) & (F.col("value") != ""), F.struct("no", "value")))), lambda x: x["value"])
    delay = F.max_by(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("int")), F.when((F.col("mine") == 1) & (F.col("field") == "crawl-delay"), F.col("no")))
    sitemap = F.max_by(F.when(F.col("field") == "sitemap", F.col("value")), F.when(F.col("field") == "sitemap", F.col("no")))
    return rows.groupBy("host").agg(rule("allow").alias("allow"), rule("disallow").alias("disallow"), delay.alias("crawl_delay"), sitemap.alias("sitemap"))


def pattern_regex(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: * is any run, $ at the end anchors, else a prefix."""
    anchored = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def path_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """True if an allow pattern matches, else false if a disallow pattern does, else true."""
    hit = lambda rules: F.exists(F.coalesce(rules, F.array().cast("array<string>")), lambda p: F.regexp_like(path, pattern_regex(p)))
    return hit(allow) | ~hit(disallow)


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with path and allowed; a host without rules allows all."""
    path = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    rows = pages.withColumn("path", path).withColumn("host", host(url))
    joined = rows.join(rules.select("host", "allow", "disallow"), "host", "left")
    return joined.withColumn("allowed", path_allowed(F.col("path"), F.col("allow"), F.col("disallow"))).drop("allow", "disallow")


ROBOTS = "User-agent: *\nDisallow: /en/\nDisallow: /*.html$\nAllow: /en/4\nCrawl-delay: 2\nSitemap: https://a.example/s.xml\n\nUser-agent: other\nDisallow: /"


@query("""
WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, path, CASE WHEN NOT ends_with(host, '.com') THEN TRUE WHEN starts_with(path, '/en/4') THEN TRUE WHEN starts_with(path, '/en/') OR ends_with(path, '.html') THEN FALSE ELSE TRUE END AS allowed FROM p""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots text for all .com hosts of the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    texts = pages.select(host("url").alias("host")).distinct().filter("host LIKE '%.com'").withColumn("text", F.lit(ROBOTS))
    return allowed(pages, robots_rules(texts, "lodestar")).select("page_id", "path", "allowed")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/robots.txt' AS robots_url FROM pages")
def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0), F.lit("/robots.txt")).alias("robots_url"))


def frontier(start: DataFrame, edges: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(node, depth) reachable from start (node) over edges (src, dst), by levels.

    Each level is an anti-join of the next nodes with those seen, written to the shared folder, so a long
    search has a short lineage. With a budget, the level that would pass it is cut in node order.
    """
    spark = start.sparkSession
    folder = f"{shared_folder(spark)}/frontier-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    level = start.select("node").distinct().withColumn("depth", F.lit(0))
    schema = level.schema
    seen = None
    for d in range(depth + 1):
        if seen is not None and budget is not None:
            left = budget - seen.count()
            if left <= 0:
                break
            level = level.orderBy("node").limit(left)
        elif budget is not None:
            level = level.orderBy("node").limit(budget)
        level.write.parquet(f"{folder}/{d}")
        level = spark.read.schema(schema).parquet(f"{folder}/{d}")
        if level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
        level = edges.join(level, edges["src"] == level["node"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d + 1))
    return seen if seen is not None else level


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, page_id * 3 + k AS dst FROM pages, (VALUES (1), (2), (3)) AS t(k), n WHERE page_id * 3 + k < n.n),
b(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node""")
def crawl_bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within four links of the first, where page p links to 3p + 1, 3p + 2 and 3p + 3."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.array(*(F.col("page_id") * 3 + k for k in (1, 2, 3)))).alias("dst")).filter(F.col("dst") < n)
    return frontier(spark.range(1).select(F.col("id").alias("node")), edges, 4)


def admission(requests: DataFrame, key: str, at: str, order: str, policy: Politeness) -> DataFrame:
    """requests with admitted_us: the time at which each is admitted by its key's token bucket.

    The n-th request of a key (from 0) waits until the bucket of `burst` tokens that refills at `rps` has
    one. With d_n = max(t_n, d_(n - 1)) + period, the time at which the bucket would be full again, it is admitted at
    max(t_n, d_(n - 1) - (burst - 1) periods), the greatest of t_n and t_j + (n - j - burst + 1) periods for j < n. So one running maximum by key gives all times, with built-in functions.
    """
    period = int(1_000_000 / policy.rps)
    by = Window.partitionBy(key).orderBy(at, order)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.withColumn("__n", F.row_number().over(by).cast("long")).withColumn("__t", t)
    top = F.max(F.col("__t") - F.col("__n") * period).over(by.rowsBetween(Window.unboundedPreceding, 0))
    admitted = F.greatest(F.col("__t"), top + (F.col("__n") - policy.burst + 1) * period)
    return rows.withColumn("admitted_us", admitted).drop("__n", "__t")


@query("""
WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id, greatest(t, max(t - n * 3600000000) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + (n - 1) * 3600000000) AS admitted_us FROM r""")
def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events admitted by user at one an hour with a burst of two."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return admission(events, "user_id", "ts", "event_id", Politeness(1 / 3600, 2)).select("event_id", "user_id", "admitted_us")


@query("""SELECT event_type, time_bucket(INTERVAL 10 SECOND, ts)::VARCHAR AS bucket, round(avg(value), 6) AS mean, CAST(CASE WHEN avg(value) > 50 THEN 0.9 WHEN avg(value) < 25 THEN 1.1 ELSE 1.0 END AS DOUBLE) AS factor FROM events GROUP BY 1, 2""")
def adaptive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean response by 10 seconds and key, and the factor it asks for."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy("event_type", F.window("ts", "10 seconds").alias("w")).agg(F.avg("value").alias("m"))
    factor = F.when(F.col("m") > 50, 0.9).when(F.col("m") < 25, 1.1).otherwise(1.0)
    return by.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), F.round("m", 6).alias("mean"), factor.alias("factor"))


def replay(times: list[int], policy: Politeness) -> list[int]:
    """What `admission` gives for one key's requests in order, by simulating the bucket: for tests."""
    period, due, out = int(1_000_000 / policy.rps), None, []
    for t in times:
        now = t if due is None else max(t, due - (policy.burst - 1) * period)
        due = max(t, due if due is not None else t) + period
        out.append(now)
    return out
