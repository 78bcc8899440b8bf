"""Analytics over crawled pages and documents, in built-in functions and SQL; writes and upserts; ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.registry import QUERIES, SQL, query, scratch, table
from lodestar.sources import html as H

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def host(url: Column | str) -> Column:
    """The URL's host, or unknown."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")), F.lit("unknown"))


def crawled_pages(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """The page table: domain, byte length, content hash, language and time of the crawl from (page_id, crawled_at)."""
    rows = pages.select(
        F.col("page_id").alias("id"), "url", host("url").alias("domain"), F.octet_length("html").alias("content_length"), F.md5(F.col("html").cast("binary")).alias("content_hash"),
        F.coalesce(F.nullif(F.regexp_extract("html", r'<html lang="([A-Za-z-]+)"', 1), F.lit("")), F.lit("unknown")).alias("language"),
    )
    return rows.join(fetched, rows["id"] == fetched["page_id"], "left").drop("page_id")


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are taken to be fetched at the time of the event of their number."""
    return crawled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("crawled_at")))


_PAGES = """
WITH cp AS (SELECT page_id AS id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, CAST(strlen(html) AS INTEGER) AS content_length, md5(html) AS content_hash,
  regexp_extract(html, '<html lang="([A-Za-z-]+)"', 1) AS language, ts AS crawled_at FROM pages LEFT JOIN events ON event_id = page_id)"""


@query(_PAGES + " SELECT domain, count(*) AS page_count, round(avg(content_length), 4) AS avg_length, strftime(max(crawled_at), '%Y-%m-%d %H:%M:%S') AS last_crawled, count(DISTINCT language) AS languages FROM cp GROUP BY domain")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("page_count"), F.round(F.avg("content_length"), 4).alias("avg_length"), F.date_format(F.max("crawled_at"), "yyyy-MM-dd HH:mm:ss").alias("last_crawled"), F.countDistinct("language").alias("languages"))


def timeline(pages: DataFrame, until: str, days: int) -> DataFrame:
    """By day of the `days` before a reference date: pages, domains, mean length."""
    kept = pages.filter((F.col("crawled_at") >= F.date_sub(F.lit(until).cast("date"), days).cast("timestamp")) & (F.col("crawled_at") < F.lit(until).cast("timestamp")))
    return kept.groupBy(F.to_date("crawled_at").cast("string").alias("crawl_date")).agg(F.count("*").alias("pages"), F.countDistinct("domain").alias("domains"), F.round(F.avg("content_length"), 4).alias("avg_length"))


@query(_PAGES + " SELECT CAST(CAST(crawled_at AS DATE) AS VARCHAR) AS crawl_date, count(*) AS pages, count(DISTINCT domain) AS domains, round(avg(content_length), 4) AS avg_length FROM cp WHERE crawled_at >= DATE '2024-01-31' - INTERVAL 30 DAY AND crawled_at < DATE '2024-01-31' GROUP BY 1")
def crawl_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(_crawled(spark, sf_dir), "2024-01-31", 30)


@query(_PAGES + " SELECT id, url, domain, content_length, language FROM cp WHERE domain = 'ththre.example.com' ORDER BY crawled_at DESC, id LIMIT 10")
def pages_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest pages of a domain."""
    return _crawled(spark, sf_dir).filter("domain = 'ththre.example.com'").orderBy(F.col("crawled_at").desc(), "id").select("id", "url", "domain", "content_length", "language").limit(10)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of both with one key, the one of the greatest `order`; ties go to new."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("__new").desc()))
    return both.withColumn("__r", last).filter("__r = 1").drop("__r", "__new")


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events were upserted by user: the last event of each."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "at")
    first, second = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    return upsert(first, second, "user_id", "at").drop("at")


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(_PAGES + " SELECT content_length > 5000 AS long, language, count(*) AS pages FROM cp WHERE language IN ('en', 'fr') AND url LIKE '%page=2%' GROUP BY 1, 2")
def dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions composed at run time: languages and a keyword in the URL."""
    conditions = [F.col("language").isin("en", "fr"), F.col("url").contains("page=2")]
    rows = _crawled(spark, sf_dir)
    for c in conditions:
        rows = rows.filter(c)
    return rows.groupBy((F.col("content_length") > 5000).alias("long"), "language").agg(F.count("*").alias("pages"))


@query("SELECT page_id, octet_length(encode(html)) <= 10000000 AND octet_length(encode(html)) > 0 AS accepted, CASE WHEN html LIKE '<!DOCTYPE html>%' THEN 'text/html' ELSE 'text/plain' END AS content_type FROM pages")
def fetch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch would check: size under 10 MB, and the content type."""
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", ((size <= 10_000_000) & (size > 0)).alias("accepted"), F.when(F.col("html").startswith("<!DOCTYPE html>"), "text/html").otherwise("text/plain").alias("content_type"))


_LINKS = """(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link, count(*) AS times FROM {_LINKS} GROUP BY 1, 2")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by page from the parsed tree, resolved against the page's URL."""
    out = H.extracted(table(spark, sf_dir, "pages"), fields=("links",))
    return out.select("page_id", F.explode("links").alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("times"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
  regexp_extract(html, '<html lang="([A-Za-z-]+)"', 1) AS language FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.extracted(table(spark, sf_dir, "pages"), fields=("title", "language")).select("page_id", "title", "language")


@query(_PAGES + f", l AS (SELECT p.page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, href FROM {_LINKS} p) SELECT domain, count(*) AS out_links, count(DISTINCT href) AS targets FROM l GROUP BY domain")
def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and distinct targets of each domain's pages, with built-in functions on the raw page; all links stay on their domain."""
    links = table(spark, sf_dir, "pages").select(host("url").alias("domain"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("domain").agg(F.count("*").alias("out_links"), F.countDistinct("href").alias("targets"))


@query(f"SELECT regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link, count(*) AS in_links, count(DISTINCT page_id) AS pages FROM {_LINKS} GROUP BY 1")
def link_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to each URL and the pages that have them; counted by (link, page) first, so a URL that many pages link to is split."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("site"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    times = pages.groupBy(F.concat("site", "href").alias("link"), "page_id").agg(F.count("*").alias("n"))
    return times.groupBy("link").agg(F.sum("n").alias("in_links"), F.count("page_id").alias("pages"))


@query()
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, markdown and metadata of every page."""
    return H.extracted(table(spark, sf_dir, "pages"))


_PLAIN = "replace(replace(replace(regexp_replace(regexp_replace({0}, '(?is)<!--.*?-->|<(script|style|noscript)\\b.*?</(script|style|noscript)>|<[/!]?[a-z][^>]*>', ' ', 'g'), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
_SQUEEZED = f"trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT page_id, url, {_SQUEEZED.format('html')} AS content, list_filter(list_transform(regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1), lambda x: {_SQUEEZED.format('x')}), lambda x: x <> '')[-1] AS title FROM pages),
w AS (SELECT *, CAST(len(string_split(content, ' ')) AS INTEGER) AS word_count FROM t WHERE strlen(content) >= 500)
SELECT page_id, url, coalesce(title, content) AS headline, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS published_date, word_count, CAST(greatest(1, word_count // 200) AS INTEGER) AS reading_time, CAST([] AS VARCHAR[]) AS tags, content FROM w""")
def article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ("title", "text", "open_graph", "author", "published_date", "keywords")
    return H.articles(H.extracted(table(spark, sf_dir, "pages"), fields=needed))


@query("""WITH s(xml) AS (VALUES ('<urlset><url><loc> https://a.example/x </loc></url><url><loc>https://b.example/y?z=1</loc></url></urlset>'), ('<urlset><loc>not a url</loc></urlset>'))
SELECT trim(u) AS url FROM (SELECT unnest(regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1)) AS u FROM s) WHERE regexp_matches(trim(u), '^[a-z]+://')""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = spark.createDataFrame([("<urlset><url><loc> https://a.example/x </loc></url><url><loc>https://b.example/y?z=1</loc></url></urlset>",), ("<urlset><loc>not a url</loc></urlset>",)], "xml string")
    return from_sitemaps(xml)


def from_sitemaps(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """URLs in <loc> that parse as absolute."""
    return sitemaps.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>([^<]*)</loc>"), 1)).alias("u")).select(F.trim("u").alias("url")).filter(F.col("url").rlike("^[a-z]+://"))


def crawl_urls(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, status, page_id): each asked URL looked up in the stored pages; what is missing is an error row, not an exception."""
    found = urls.join(pages.select("url", "page_id"), "url", "left")
    return found.select("url", F.when(F.col("page_id").isNull(), "error").otherwise("success").alias("status"), "page_id")


@query("""WITH u AS (SELECT url FROM pages UNION ALL SELECT 'https://missing.example/' || page_id FROM pages WHERE page_id % 10 = 0)
SELECT CASE WHEN p.page_id IS NULL THEN 'error' ELSE 'success' END AS status, count(*) AS urls FROM u LEFT JOIN pages p USING (url) GROUP BY 1""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    asked = pages.select("url").unionByName(pages.filter("page_id % 10 = 0").select(F.concat(F.lit("https://missing.example/"), F.col("page_id").cast("string")).alias("url")))
    return crawl_urls(asked, pages).groupBy("status").agg(F.count("*").alias("urls"))


@query("SELECT text AS query, count(*) AS times FROM conversations WHERE role = 'user' GROUP BY text ORDER BY times DESC, query LIMIT 20")
def popular_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.groupBy(F.col("text").alias("query")).agg(F.count("*").alias("times")).orderBy(F.col("times").desc(), "query").limit(20)


def log_queries(rows: DataFrame, folder: str, kind: str = "query") -> None:
    """Appends rows (query, at, user, filters as a map) to the log; kind: query or click."""
    rows.select(F.lit(kind).alias("kind"), "query", F.col("at").cast("timestamp").alias("at"), "user", F.to_json("filters").alias("filters")).write.mode("append").parquet(folder)


def query_report(log: DataFrame) -> DataFrame:
    """By query: how often asked and clicked, and clicks for each time asked."""
    times, clicks = F.count_if(F.col("kind") == "query"), F.count_if(F.col("kind") == "click")
    return log.groupBy("query").agg(times.alias("times"), clicks.alias("clicks"), F.round(clicks / F.nullif(times, F.lit(0)), 6).alias("rate"))


@query("""SELECT text AS query, count(*) AS times, count(*) FILTER (WHERE conv_id % 3 = 0) AS clicks, round(count(*) FILTER (WHERE conv_id % 3 = 0) / CAST(count(*) AS DOUBLE), 6) AS rate
FROM conversations WHERE role = 'user' GROUP BY text""")
def query_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions logged in two appends, and clicks on a third of them."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("text").alias("query"), F.lit("2024-01-01").alias("at"), F.col("conv_id").alias("user"), F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("filters"))
    folder = scratch(spark, "query-log")
    log_queries(asked.filter("user % 2 = 0"), folder)
    log_queries(asked.filter("user % 2 = 1"), folder)
    log_queries(asked.filter("user % 3 = 0"), folder, "click")
    return query_report(spark.read.parquet(folder))


@query("""SELECT d.doc_id, p.page_id, p.url, d.lang AS language, d.n_chars FROM documents d JOIN pages p ON d.doc_id % 97 = p.page_id WHERE d.lang = 'en' AND contains(d.text, 'the') AND d.doc_id % 2 = 0""")
def code_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples (documents taken as code of the page of their id modulo 97) by language and keyword with fenced text only, joined with
    their pages."""
    docs = table(spark, sf_dir, "documents")
    preview = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    code = docs.filter(F.col("lang") == "en").filter(F.col("text").contains("the")).withColumn("preview", preview).filter(H.has_fence("preview"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return code.withColumn("page_id", F.col("doc_id") % 97).join(pages, "page_id").select("doc_id", "page_id", "url", F.col("lang").alias("language"), "n_chars")


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1000, 1000).when(n <= 10_000, 10_000).when(n <= 100_000, 100_000).otherwise(1_000_000)


@query("""SELECT role, CASE WHEN length(text) <= 1000 THEN 1000 WHEN length(text) <= 10000 THEN 10000 WHEN length(text) <= 100000 THEN 100000 ELSE 1000000 END AS bucket,
  count(*) AS n, round(avg(length(text)), 4) AS mean, round(avg(CASE WHEN turn = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM conversations GROUP BY 1, 2""")
def query_stats_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").groupBy("role", size_bucket(n).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.avg(F.when(F.col("turn") == 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def extract_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("digit")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def row_json(df: DataFrame) -> DataFrame:
    """Rows of any query as JSON objects."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_json(table(spark, sf_dir, "region"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(split_part(text, chr(10), 1))) > 100 THEN substr(split_part(text, chr(10), 1), 1, 97) || '...' ELSE split_part(text, chr(10), 1) END AS title,
  substr(text, 1, 500) AS preview, len(regexp_split_to_array(text, chr(10))) AS lines FROM documents""")
def title_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.octet_length(first) > H.TITLE_BYTES, F.concat(F.substring(first, 1, 97), F.lit("..."))).otherwise(first).alias("title"), F.substring("text", 1, H.PREVIEW).alias("preview"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


def custom_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Any SQL over the tables of a folder, registered as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


#: Ad-hoc queries that both engines run as they stand.
AD_HOC = {
    "pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "top_orders": "SELECT o_orderkey, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey ORDER BY total DESC, o_orderkey LIMIT 25",
    "no_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "frames": "SELECT o_orderkey, lead(o_orderkey) OVER w AS next_order, CAST(ntile(4) OVER w AS INT) AS quarter, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_max FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "running": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "sets": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "brands": "WITH b AS (SELECT p_brand, p_size, avg(p_retailprice) AS price FROM part GROUP BY p_brand, p_size) SELECT p_brand, count(*) AS sizes, round(max(price), 2) AS dearest FROM b GROUP BY p_brand HAVING count(*) > 5",
}
for _name, _sql in AD_HOC.items():
    QUERIES[f"custom_sql_{_name}"] = lambda spark, sf_dir, sql=_sql: custom_sql(spark, sf_dir, sql)
    SQL[f"custom_sql_{_name}"] = _sql
