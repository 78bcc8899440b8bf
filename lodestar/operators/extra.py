"""Smaller operators: pooling, vector bytes, JSON values, scans of stored pages, synthetic vectors, benchmark summaries."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.registry import query, table

# The cap of a full scan of stored pages.
SCAN_CAP = 10_000


def pooled(tokens: DataFrame, group: str, vec: str, mask: str | None = None, order: str | None = None) -> DataFrame:
    """(group, pos, mean, largest, mean_sqrt, cls) of token vectors whose mask is true: mean, maximum, mean times the root of
    their number, and the first by `order`; by (group, position) with partial sums, so a long text needs no row of its own."""
    kept = tokens.filter(mask) if mask else tokens
    cells = kept.select(group, F.col(order or group).alias("__order"), F.posexplode(vec).alias("pos", "x")).groupBy(group, "pos")
    mean = F.avg(F.col("x").cast("double"))
    return cells.agg(mean.alias("mean"), F.max("x").cast("double").alias("largest"), (mean * F.sqrt(F.count("*"))).alias("mean_sqrt"), F.min_by("x", "__order").cast("double").alias("cls")).withColumn("pos", F.col("pos") + 1)


@query("""
WITH u AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 <> 0)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) + 0.0 AS largest, round(avg(x) * sqrt(count(*)), 6) + 0.0 AS mean_sqrt, round(arg_min(x, vec_id), 6) + 0.0 AS cls FROM u GROUP BY label, pos""")
def pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as the tokens of a text, a third of them masked."""
    out = pooled(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id % 3 <> 0", "vec_id")
    six = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return out.select("label", "pos", six("mean"), six("largest"), six("mean_sqrt"), six("cls"))


def to_bytes(vec: Column) -> Column:
    """Little-endian 32-bit floats of a vector, cut from the values of a whole Arrow batch."""

    @F.pandas_udf("binary")
    def pack(s):  # noqa: ANN001, ANN202
        import numpy as np

        kept = s.dropna()
        raw = np.concatenate([np.asarray(v, dtype="<f4") for v in kept]).tobytes() if len(kept) else b""
        ends = np.cumsum([4 * len(v) for v in kept], dtype=np.int64)
        out = s.astype(object).where(s.isna(), None)
        out[kept.index] = [raw[i:j] for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
        return out

    return pack(vec)


def from_bytes(data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(s):  # noqa: ANN001, ANN202
        import numpy as np

        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return unpack(data)


@query("SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, len(embedding) = len(list_filter(embedding, lambda x: x = CAST(x AS FLOAT))) AS same FROM embeddings")
def vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each vector, and whether they give the vector back."""
    packed = table(spark, sf_dir, "embeddings").withColumn("b", to_bytes(F.col("embedding")))
    return packed.select("vec_id", F.length("b").alias("n_bytes"), (from_bytes(F.col("b")) == F.col("embedding")).alias("same"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text as a typed value and back."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"))


@query("SELECT page_id, url, substr(html, 1, 500) AS preview FROM pages WHERE url IS NOT NULL AND html IS NOT NULL ORDER BY page_id LIMIT 10000")
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored pages with a URL, up to the cap of a scan, which is the feature."""
    pages = table(spark, sf_dir, "pages").na.drop(subset=["url", "html"])
    return pages.orderBy("page_id").limit(SCAN_CAP).select("page_id", "url", F.substring("html", 1, 500).alias("preview"))


def synthetic_vectors(spark: SparkSession, n: int, dims: int, seed: int = 42) -> DataFrame:
    """(vec_id, name, embedding) uniform in [-1, 1), by hashes; the same for a seed, however the rows are partitioned."""
    hashed = lambda i: F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")))
    value = lambda i: (F.conv(F.substring(hashed(i), 1, 6), 16, 10).cast("double") / float(1 << 23) - 1).cast("float")
    return spark.range(n).select(F.col("id").alias("vec_id"), F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("name"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("embedding"))


@query("""SELECT i AS vec_id, 'doc_' || i AS name, CAST(j AS INTEGER) AS pos, CAST(CAST('0x' || substr(md5('42-' || i || '-' || j), 1, 6) AS INTEGER) / 8388608.0 - 1 AS DOUBLE) AS val
FROM range(1000) t(i), range(16) u(j)""")
def synthetic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_vectors(spark, 1000, 16).select("vec_id", "name", F.posexplode("embedding").alias("pos", "val")).withColumn("val", F.col("val").cast("double"))


def rfc3339(text: Column | str, fallback: Column | None = None) -> Column:
    """A date and time with an offset as a timestamp; what does not parse gives the fallback, or the current time."""
    c = F.col(text) if isinstance(text, str) else text
    shaped = F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"))
    return F.coalesce(F.when(shaped, F.try_to_timestamp(F.upper(c))), F.current_timestamp() if fallback is None else fallback)


@query("""SELECT event_id, strftime(CASE event_id % 4 WHEN 3 THEN TIMESTAMP '2000-01-01' WHEN 0 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events written with an offset, as UTC, or without one, which does not parse."""
    t = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = F.concat(t, F.when(kind == 0, "+02:30").when(kind == 1, "Z").when(kind == 2, ".0+00:00").otherwise(""))
    at = rfc3339(text, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


def node_json(nodes: DataFrame, id_col: str, labels: Column, properties: list[str]) -> DataFrame:
    """Graph nodes as JSON objects {id, labels, properties}."""
    return nodes.select(F.to_json(F.struct(F.col(id_col).alias("id"), labels.alias("labels"), F.struct(*properties).alias("properties"))).alias("json"))


@query("""SELECT '{"id":' || n_nationkey || ',"labels":["Nation","' || r_name || '"],"properties":{"n_name":"' || n_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_rows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return node_json(nodes, "n_nationkey", F.array(F.lit("Nation"), F.col("r_name")), ["n_name"])


@query("""SELECT event_type AS test_name, count(*) AS runs, round(max(value), 6) AS slowest, round(avg(value), 6) AS mean, round(max(value) / avg(value), 6) AS ratio FROM events GROUP BY 1""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("test_name"))
    return rows.agg(F.count("*").alias("runs"), F.round(F.max("value"), 6).alias("slowest"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") / F.avg("value"), 6).alias("ratio"))


@query("""SELECT doc_id, CASE WHEN n_chars = length(text) THEN round(CAST(1 - least(0.1 * (doc_id % 12), 0.8) AS DOUBLE), 6) ELSE 0.3 END AS confidence, round(least(100.0, CAST(doc_id AS DOUBLE) * 100.0 / 150), 6) AS progress FROM documents""")
def confidence_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by number of issues, and progress in percent, capped."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("n_chars") == F.length("text"), F.round(1 - F.least(F.lit(0.1) * (F.col("doc_id") % 12), F.lit(0.8)), 6)).otherwise(0.3).alias("confidence"), F.round(F.least(F.lit(100.0), F.col("doc_id") * 100.0 / 150), 6).alias("progress"))


@query("SELECT c_custkey, CAST(cum AS DOUBLE) AS cum FROM (SELECT c_custkey, sum(c_acctbal) OVER w AS cum, sum(c_acctbal) OVER () AS total, coalesce(sum(c_acctbal) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS c_acctbal FROM customer) WINDOW w AS (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)) WHERE 2 * cum >= total AND 2 * before < total")
def half_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at which a running weight reaches half of the total: by ranges of keys first (one row each), then inside one."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.abs("c_acctbal")).cast("long").alias("w"))
    cells = rows.groupBy(F.expr("c_custkey div 1024").alias("cell")).agg(F.sum("w").alias("w"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("cum", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy()))
    at = cells.filter("2 * cum >= total AND 2 * (cum - w) < total").select("cell", (F.col("cum") - F.col("w")).alias("before"), "total")
    inside = rows.withColumn("cell", F.expr("c_custkey div 1024")).join(F.broadcast(at), "cell")
    run = F.sum("w").over(Window.partitionBy("cell").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return inside.withColumn("cum", run).filter("2 * cum >= total AND 2 * (cum - w) < total").select("c_custkey", F.col("cum").cast("double").alias("cum"))


class Ring:
    """A byte buffer of fixed size on the driver: writes that do not fit are refused, reads take the oldest bytes."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, deque()

    def write(self, data: bytes) -> bool:
        if len(self.held) + len(data) > self.capacity:
            return False
        self.held.extend(data)
        return True

    def read(self, n: int) -> bytes:
        return bytes(self.held.popleft() for _ in range(min(n, len(self.held))))
